"""Quality scores: random Fourier features over document statistics, ridge, isotonic calibration.

1. One narrow pass turns every whole text into a row of statistics (sizes, shares of
   character kinds, repetition of words and lines, entropy); they are written once,
   about a hundred bytes a document.
2. Labelled rows of the training folds get features sqrt(2 / D) * cos(W z + b) of
   their standardised statistics z, with W drawn for a Gaussian kernel of width
   ``width``.  Every partition sums its Z'Z and Z'y; those sums meet row by row of
   the matrix, so no task adds whole matrices and the driver gets the totals only.
   The sums are kept by fold: a ridge model of all folds scores documents, models
   that leave a fold out score that fold for the next step.
3. Left-out scores, counted on a grid with their labels, are made monotone by
   pooling adjacent violators; the pooled shares, joined linearly, are the score.

Everything learned follows all labelled rows; what reaches the driver has a fixed
size (FOLDS * (D + 1) rows, GRID bins).

Defined results: null and empty texts have statistics of nothing and get a score
like any other; null ids are scored and teach nothing; repeated rows are each
scored, and each teaches; several labels of an id count as their mean; without a
labelled row every score is 0.5, with labels of one kind that kind's share; an
empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_WORD, U64, Slab, crc_bucket, materialize, narrow_batches, prefix_hash, slabs, span_hash, words

STATS = ("log_bytes", "log_words", "word_bytes", "word_spread", "long_word", "letters", "upper", "digits", "sentence_marks", "calls", "symbols", "spaces", "foreign", "lines", "line_bytes", "distinct_words", "top_word", "same_word_next", "distinct_pairs", "distinct_lines", "no_letter", "capital", "entropy", "ended_lines")
FOLDS = 4
GRID = 2048
LOW, HIGH = -0.5, 1.5


def _kind(chars: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


LETTER = _kind(range(65, 91)) | _kind(range(97, 123)) | _kind(range(128, 256))
UPPER, DIGIT, FOREIGN = _kind(range(65, 91)), _kind(range(48, 58)), _kind(range(128, 256))
MARKS, CALLS = _kind(b".,;:?'\"()-"), _kind(b"!")
SYMBOLS = ~(LETTER | DIGIT | MARKS | CALLS) & SPACE_WORD


def _most(x: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The largest x of each document, whose values are x[before[i]:before[i + 1]]; 0 if none."""
    out = np.zeros(len(before) - 1)
    some = np.flatnonzero(np.diff(before))
    if len(some):
        out[some] = np.maximum.reduceat(x, before[some])
    return out


def _distinct(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document, its number of distinct keys (by 44 bits) and the count of its most frequent one."""
    x = np.sort((doc.astype(U64) << U64(44)) | (key >> U64(20)))
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    kinds = np.bincount((x[first] >> U64(44)).astype(np.int64), minlength=n)
    return kinds.astype(float), _most(np.diff(np.append(first, len(x))), np.append(0, np.cumsum(kinds)))


def text_stats(slab: Slab) -> np.ndarray:
    """One row of STATS for each text of a slab."""
    data, offs = slab.data, slab.offs
    n, size = len(offs) - 1, np.diff(offs).astype(float)
    some = np.maximum(size, 1)

    of_byte = np.bincount(np.repeat(np.arange(n) * 256, np.diff(offs)) + data, minlength=n * 256).reshape(n, 256) / some[:, None]

    def share(kind: np.ndarray) -> np.ndarray:
        return of_byte @ kind.astype(float)

    start, end, before = words(slab)
    doc = np.repeat(np.arange(n), np.diff(before))
    length = (end - start).astype(float)
    count = np.diff(before).astype(float)
    many = np.maximum(count, 1)
    hashed = prefix_hash(data)
    key = span_hash(hashed, start, end)
    by_doc = lambda x: np.bincount(doc, x, n)
    mean = by_doc(length) / many
    letters = np.append(np.int32(0), np.cumsum(LETTER[data], dtype=np.int32))
    next_same = np.flatnonzero((key[1:] == key[:-1]) & (doc[1:] == doc[:-1]))
    pair = key[1:] * U64(0x9E3779B97F4A7C15) + key[:-1]
    inside = doc[1:] == doc[:-1]
    pairs, _ = _distinct(doc[1:][inside], pair[inside], n)
    kinds, top = _distinct(doc, key, n)
    line = Slab(slab.lo, slab.hi, data, offs)
    l_start, l_end, l_before = words(line, _kind(set(range(256)) - {10}))
    l_doc = np.repeat(np.arange(n), np.diff(l_before))
    l_count = np.maximum(np.diff(l_before), 1)
    l_kinds, _ = _distinct(l_doc, span_hash(hashed, l_start, l_end), n)
    ended = np.bincount(l_doc, _kind(b".!?")[data[l_end - 1]], n) if len(l_end) else np.zeros(n)
    entropy = -(of_byte * np.log2(np.maximum(of_byte, 1e-12))).sum(1)
    return np.stack(
        [
            np.log1p(size), np.log1p(count), mean, np.sqrt(np.maximum(by_doc(length**2) / many - mean**2, 0)), np.log1p(_most(length, before)),
            share(LETTER), share(UPPER), share(DIGIT), share(MARKS), share(CALLS), share(SYMBOLS), share(~SPACE_WORD), share(FOREIGN),
            np.diff(l_before) / many, np.log1p(size / l_count), kinds / many, top / many, np.bincount(doc[next_same], minlength=n) / many, pairs / np.maximum(count - 1, 1), l_kinds / l_count,
            by_doc(letters[end] == letters[start]) / many, by_doc(UPPER[data[start]]) / many, entropy, ended / l_count,
        ],
        axis=1,
    ).astype(np.float32)


def document_stats(documents: DataFrame) -> DataFrame:
    """doc_id and its statistics as packed 32-bit floats."""
    narrow_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row.tobytes() for s in slabs(batch.column(1)) for row in text_stats(s)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["doc_id", "stats"])

    rows = documents.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, stats binary")


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(len(col), len(STATS)).astype(float)


def partition_sums(df: DataFrame, total: Callable[[pa.RecordBatch], np.ndarray | None], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of total(batch) over all batches, an array of `shape`.

    Each partition adds up its own, rows of equal number meet in one task and are
    added in the order of their partitions, so a repeated run gives equal bits.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        acc = None
        for batch in batches:
            if batch.num_rows:
                x = total(batch)
                acc = x if acc is None else acc + x
        if acc is not None:
            rows = acc.reshape(shape[0], -1)
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(rows)), pa.int32()), "part": pa.array([part] * len(rows), pa.int32()), "v": pa.array([r.tobytes() for r in rows], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = np.frombuffer(v, float)
                acc[i] = acc[i] + x if i in acc else x
        yield pa.RecordBatch.from_pydict({"i": pa.array(list(acc), pa.int32()), "v": pa.array([x.tobytes() for x in acc.values()], pa.binary())})

    parts = df.mapInArrow(own, "i int, part int, v binary").repartition("i").sortWithinPartitions("i", "part")
    out = np.zeros((shape[0], int(np.prod(shape[1:], dtype=int))))
    for r in parts.mapInArrow(add, "i int, v binary").collect():
        out[r["i"]] = np.frombuffer(r["v"], float)
    return out.reshape(shape)


def pool_adjacent(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit by pooling: (centre, share) of each pool of the points in order of x."""
    pools: list[list[float]] = []
    for xi, yi, wi in zip(x.tolist(), y.tolist(), weight.tolist(), strict=True):
        pools.append([xi * wi, yi * wi, wi])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    p = np.array(pools).reshape(-1, 3)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


@dataclass
class QualityModel:
    """Standardisation, feature map, ridge weights and the knots of the calibration."""

    mean: np.ndarray
    scale: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        z = np.clip((stats - self.mean) / self.scale, -5, 5)
        return np.hstack([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.freq + self.phase), np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return self.features(stats) @ (self.weights if weights is None else weights)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), *self.knots)


def fit(train: DataFrame, *, features: int = 256, width: float = 2.0, ridge: float = 1e-4, seed: int = 1) -> QualityModel:
    """A model of rows (stats, fold, y).

    width: the kernel's width in units of sqrt(number of statistics); ridge: penalty
    as a share of the number of rows.
    """
    p, d = len(STATS), features

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column("stats"))
        return np.stack([np.full(p, float(len(x))), x.sum(0), (x**2).sum(0)])

    n, s1, s2 = partition_sums(train, moments, (3, p))
    mean = s1 / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(s2 / np.maximum(n, 1) - mean**2, 0))
    draw = np.random.default_rng(seed)
    model = QualityModel(mean, np.where(spread > 1e-6, spread, 1.0), draw.normal(size=(p, d)) / (width * np.sqrt(p)), draw.uniform(0, 2 * np.pi, d), np.zeros(d + 1), (np.zeros(1), np.full(1, 0.5)))
    if not n[0]:
        return model
    shared = train.sparkSession.sparkContext.broadcast(model)

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        z, y, fold = shared.value.features(_matrix(batch.column("stats"))), np.asarray(batch.column("y")), np.asarray(batch.column("fold"))
        return np.concatenate([z[fold == f].T @ np.column_stack([z[fold == f], y[fold == f]]) for f in range(FOLDS)])

    sums = partition_sums(train, normal, (FOLDS * (d + 1), d + 2)).reshape(FOLDS, d + 1, d + 2)

    def solve(s: np.ndarray) -> np.ndarray:
        """The last feature is the constant: its diagonal is the number of rows, and it isn't shrunk."""
        penalty = np.full(d + 1, ridge * max(s[d, d], 1.0))
        penalty[d] = 1e-9
        return np.linalg.solve(s[:, : d + 1] + np.diag(penalty), s[:, d + 1])

    total = sums.sum(0)
    model.weights = solve(total)
    left_out = np.stack([solve(total - s) if total[d, d] > s[d, d] else model.weights for s in sums])
    out_of_fold = train.sparkSession.sparkContext.broadcast((model, left_out))

    def bins(batch: pa.RecordBatch) -> np.ndarray:
        m, by_fold = out_of_fold.value
        r = np.einsum("ij,ij->i", m.features(_matrix(batch.column("stats"))), by_fold[np.asarray(batch.column("fold"))])
        b = ((np.clip(r, LOW, HIGH) - LOW) / (HIGH - LOW) * (GRID - 1)).round().astype(int)
        return np.stack([np.bincount(b, minlength=GRID), np.bincount(b, np.asarray(batch.column("y")), GRID)])

    count, good = partition_sums(train, bins, (2, GRID))
    at = np.flatnonzero(count)
    model.knots = pool_adjacent(LOW + at * (HIGH - LOW) / (GRID - 1), good[at] / count[at], count[at])
    return model


def training_rows(stats: DataFrame, labels: DataFrame, label: str = "quality", holdout: tuple[int, int] = (5, 0)) -> DataFrame:
    """stats, fold and mean label of the labelled rows outside the held-out fold."""
    mod, out = holdout
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("_y")).where("_id is not null and _y is not null").where(crc_bucket(F.col("_id"), mod) != out).groupBy("_id").agg(F.avg((F.col("_y") > 0).cast("double")).alias("y"))
    return stats.join(known, F.col("doc_id") == F.col("_id")).select("stats", F.pmod(F.xxhash64("_id"), F.lit(FOLDS)).cast("int").alias("fold"), "y")


def score(stats: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and its score, 0 to 1, for every row of statistics."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = shared.value.score(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(x, 0, 1), pa.float64())], ["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def quality(documents: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **params) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents."""
    stats = materialize(document_stats(documents), "quality-stats")
    model = fit(materialize(training_rows(stats, labels), "quality-train", small=True), **params)
    return score(stats, model).select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
