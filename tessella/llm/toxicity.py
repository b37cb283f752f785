"""Toxicity scores by non-negative positive-unlabelled (nnPU) learning.

Confirmed toxic texts (positives) and unlabelled texts train a logistic model on
word-presence features with the class-prior-corrected, clipped risk

    R = prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)]).

The fit runs in numpy on the driver over a bounded sample (``max_positive`` +
``max_unlabelled`` rows, as word hashes, never texts); scoring is one narrow pass
over whole texts with no shuffle.

Defined results: null and empty texts have no words and get the model's base
score; null doc_id rows are scored and keep their null id; repeated rows are each
scored; an empty table gives no rows; columns besides doc_id and text are ignored.
With no confirmed positive at all, every score is the prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, crc_bucket, narrow_batches, slabs, word_hashes

#: Letters, digits and every non-ASCII byte make up a word; case is folded for A-Z.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


@dataclass
class ToxicModel:
    """Sorted word hashes with their weights, a bias and a filter of the hashes' low 16 bits."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.keys & U64(0xFFFF)).astype(np.int64)] = True

    def logits(self, hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Bias plus the weights of the distinct known words of each text."""
        n = len(before) - 1
        out = np.full(n, self.bias)
        if len(self.keys) and len(hashes):
            at = np.flatnonzero(self.seen[(hashes & U64(0xFFFF)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
            hit = self.keys[k] == hashes[at]
            doc = np.searchsorted(before, at[hit], side="right") - 1
            pair = np.unique(doc * len(self.keys) + k[hit])
            out += np.bincount(pair // len(self.keys), self.weights[pair % len(self.keys)], n)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def select_words(pos: list[np.ndarray], unl: list[np.ndarray], max_words: int, min_positive: int) -> np.ndarray:
    """Words whose rate among positives clearly exceeds the unlabelled rate, by likelihood ratio."""

    def counts(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate(rows) if rows else np.zeros(0, U64), return_counts=True)

    kp, cp = counts(pos)
    ku, cu = counts(unl)
    cp, kp = cp[cp >= min_positive], kp[cp >= min_positive]
    if not len(kp):
        return kp
    j = np.minimum(np.searchsorted(ku, kp), max(len(ku) - 1, 0))
    c_u = np.where(ku[j] == kp, cu[j], 0) if len(ku) else np.zeros(len(kp))
    n_p, n_u = len(pos), max(len(unl), 1)
    p, u = cp / n_p, (c_u + 0.5) / (n_u + 1)
    both = (cp + c_u) / (n_p + n_u)

    def ll(k: np.ndarray, n: int, q: np.ndarray) -> np.ndarray:
        q = np.clip(q, 1e-9, 1 - 1e-9)
        return k * np.log(q) + (n - k) * np.log1p(-q)

    g2 = 2 * (ll(cp, n_p, p) + ll(c_u, n_u, np.minimum(c_u / n_u, 1)) - ll(cp, n_p, both) - ll(c_u, n_u, both))
    good = np.flatnonzero((p > 2 * u) & (g2 > 15))
    good = good[np.lexsort((kp[good], -g2[good]))][:max_words]
    return np.sort(kp[good])


def fit_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, *, max_words: int = 4096, min_positive: int = 3, epochs: int = 300, rate: float = 0.1, decay: float = 1e-3) -> ToxicModel:
    """Full-batch Adam on the non-negative PU risk with the logistic loss."""
    prior = float(min(max(prior, 1e-4), 0.9))
    base = float(np.log(prior / (1 - prior)))
    keys = select_words(pos, unl, max_words, min_positive) if pos else np.zeros(0, U64)
    if not len(keys):
        return ToxicModel(np.zeros(0, U64), np.zeros(0), base, prior)

    def design(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        flat = np.concatenate(rows) if rows else np.zeros(0, U64)
        row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        k = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
        hit = keys[k] == flat
        return row[hit], k[hit], max(len(rows), 1)

    xp, xu = design(pos), design(unl)
    w, b = np.zeros(len(keys)), base
    m, v = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)

    def score(x: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
        return b + np.bincount(x[0], w[x[1]], x[2])

    def pull(x: tuple[np.ndarray, np.ndarray, int], g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(x[1], g[x[0]], len(keys)), g.sum())

    for t in range(1, epochs + 1):
        sp, su = sigmoid(score(xp)), sigmoid(score(xu))
        neg = -np.log(np.maximum(1 - su, 1e-12)).mean() + prior * np.log(np.maximum(1 - sp, 1e-12)).mean()
        minus = pull(xu, su / xu[2]) - prior * pull(xp, sp / xp[2])
        # Where the corrected negative risk falls below zero, the step undoes the over-fit instead.
        g = prior * pull(xp, (sp - 1) / xp[2]) + minus if neg >= 0 else -minus
        g[:-1] += decay * w * prior
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = np.maximum(w - step[:-1], 0), b - float(step[-1])
    return ToxicModel(keys, w, b, prior)


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for s in slabs(batch.column(1)):
            h, before = word_hashes(s, WORD)
            rows += [np.unique(h[before[i] : before[i + 1]]).tobytes() for i in range(s.hi - s.lo)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["_id", "words"])


def train(documents: DataFrame, labels: DataFrame, *, max_positive: int = 4000, max_unlabelled: int = 8000, holdout: tuple[int, int] = (4, 2)) -> ToxicModel:
    """Fits a model on rows outside the held-out fold.

    The prior is the toxic share of all labelled rows of the fold.  Positives are
    at most max_positive labelled toxic rows, unlabelled rows at most
    max_unlabelled texts of any kind, both those with the lowest hashes of the id.
    The model weighs at most 4096 words (max_words of fit_nnpu), the most telling
    ones that at least min_positive positives hold.
    """
    narrow_batches(documents.sparkSession)
    mod, out = holdout
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y")).where("_id is not null and _y is not null").where(crc_bucket(F.col("_id"), mod) != out).groupBy("_id").agg(F.max("_y").alias("_y"))
    n_lab, n_pos = known.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    prior = (n_pos + 1) / (n_lab + 2) if n_lab else 0.05
    texts = documents.select(F.col("doc_id").alias("_id"), F.col("text").alias("_t")).where("_id is not null").where(crc_bucket(F.col("_id"), mod) != out)
    n_all = texts.count()
    draw = F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(1_000_000)) / 1_000_000

    def drawn(ids: DataFrame, most: int, n: int) -> DataFrame:
        """The ids of the lowest draws, at most `most`: the same in every run, and a broadcast with a proven bound."""
        return ids.where(draw < (2 * most / n if n else 0)).distinct().orderBy(draw, "_id").limit(most)

    rows = []
    for positive, ids in ((True, drawn(known.where("_y = 1").select("_id"), max_positive, n_pos)), (False, drawn(texts.select("_id"), max_unlabelled, n_all))):
        part = texts.join(F.broadcast(ids), "_id").select("_id", "_t")
        words = part.mapInArrow(_distinct_words, f"_id {texts.schema['_id'].dataType.simpleString()}, words binary")
        # Of repeated ids one text stays, so rows are bounded too.
        rows += [(positive, r["words"]) for r in words.groupBy("_id").agg(F.min(F.struct(F.xxhash64("words"), "words"))["words"].alias("words")).collect()]
    split = {True: [], False: []}
    for positive, words in sorted(rows):
        split[positive].append(np.frombuffer(words, U64))
    return fit_nnpu(split[True], split[False], prior)


def score(documents: DataFrame, model: ToxicModel, out: str = "score") -> DataFrame:
    """documents with a double column `out`: 0 to 1, higher is likelier toxic."""
    narrow_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.bias, model.prior))
    names = [f.name for f in documents.schema if f.name != out]
    where = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = ToxicModel(*shared.value)
        for batch in batches:
            parts = [sigmoid(m.logits(*word_hashes(s, WORD))) for s in slabs(batch.column(where))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0))], [*names, out])

    kept = documents.select(*names)
    return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"`{out}` double"]))


def toxicity(documents: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **params) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents."""
    model = train(documents, labels, **params)
    scored = score(documents.select("doc_id", "text"), model).drop("text")
    return scored.select("doc_id", (crc_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
