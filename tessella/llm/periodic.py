"""Periodic runs of words by heavy/light lag counting.

A run is a stretch of consecutive words with smallest period q and at least
max(12, 2q) words that no neighbouring word extends keeping q.  A run of period q
shows as an island: max(12 - q, q) or more consecutive positions whose word stands
again q words later.  So a lag can only have runs if the text has that many equal
pairs q apart, and those pairs are counted for all lags at once:

* frequent words by exact autocorrelation: the spectra of their indicator rows are
  added and turned back once (integers, so rounding is exact);
* rare words by the differences of their positions.

Lags with enough pairs are scanned in ascending order.  A scan first looks at every
(q // 4)th position or so: an island holds four of them in a row, so a lag costs
about 4n/q comparisons, and only stretches that pass are read word by word.
Multiples of a period found are known islands: their pairs are taken off the
lag's count and they are not read again, so a text of one repeated word costs
one scan.

One narrow pass over whole texts: no shuffle, memory follows the longest text.

Defined results: words are [^\\x20\\x09-\\x0D]+ of the UTF-8 bytes, compared as they
are; null and empty texts have no words, no runs and an empty collapsed text;
null ids are kept; repeated rows are each answered; an empty table gives no rows;
columns besides the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrow_batches

#: Pairs of rare words are made in pieces of this many.
PAIRS = 1 << 20
LEAST = 12
FOUR = b"\1\1\1\1"


def lag_counts(ids: np.ndarray, heavy_cost: float = 0.1) -> np.ndarray:
    """For each lag q up to n // 2, how many positions i have ids[i] == ids[i + q].

    A word is heavy if its c * c / 2 pairs would cost more than an FFT row of the text,
    heavy_cost * size * log2(size) of them (figures of one core: 10 ns a pair, 1 ns a point and level).
    """
    n = len(ids)
    top = n // 2
    count = np.bincount(ids)
    size = 1 << int(n + top).bit_length()
    heavy = np.flatnonzero(count.astype(float) ** 2 / 2 > heavy_cost * size * np.log2(size))
    out = np.zeros(top + 1, np.int64)
    if len(heavy):
        power = np.zeros(size // 2 + 1)
        for w in heavy:
            f = np.fft.rfft(ids == w, size)
            power += f.real**2 + f.imag**2
        out += np.rint(np.fft.irfft(power, size)[: top + 1]).astype(np.int64)
    rare = np.ones(len(count), bool)
    rare[heavy] = False
    pos = np.argsort(ids, kind="stable")
    pos = pos[rare[ids[pos]]]
    own = ids[pos]
    #: How many later positions of the same word each position has.
    much = np.bincount(own)
    much = much[much > 0]
    later = np.repeat(np.cumsum(much), much) - 1 - np.arange(len(own))
    ends = np.cumsum(later)
    lo = 0
    while lo < len(own):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + PAIRS, side="right")))
        k = later[lo:hi]
        left = np.repeat(np.arange(lo, hi), k)
        step = np.arange(len(left)) - np.repeat(ends[lo:hi] - k - base, k) + 1
        gap = pos[left + step] - pos[left]
        out += np.bincount(gap[gap <= top], minlength=top + 1)
        lo = hi
    return out


def _stretches(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    framed = np.zeros(len(hit) + 2, bool)
    framed[1:-1] = hit
    edge = np.flatnonzero(framed[1:] != framed[:-1])
    return edge[::2], edge[1::2]


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n = len(ids)
    if n < LEAST:
        return []
    pairs = lag_counts(ids)
    lags = np.arange(len(pairs))
    need = np.maximum(LEAST - lags, lags)
    known: dict[int, list[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int]] = []
    for q in np.flatnonzero((pairs >= need) & (lags > 0)).tolist():
        mine, least = known.get(q, ()), max(LEAST - q, q)
        if pairs[q] - sum(e - s - q for s, e in mine) < least:
            continue
        step = least // 4
        hit = ids[: n - q : step] == ids[q::step]
        for s, e in mine:  # islands of the whole stretch [s, e), known from a divisor of q
            hit[-(-s // step) : -(-(e - q) // step)] = False
        if hit.tobytes().find(FOUR) < 0:
            continue
        a, b = _stretches(hit)
        enough = b - a >= 4
        for lo, hi in zip(a[enough].tolist(), b[enough].tolist(), strict=True):
            # A sampled stretch may hide gaps; its island may begin and end up to a step beyond it.
            x, y = max((lo - 1) * step + 1, 0), min(hi * step, n - q)
            for s, e in mine:  # a known island next to it isn't part of it
                x, y = (max(x, e - q) if s < x < e - q else x), (min(y, s) if x < s < y else y)
            s_, e_ = _stretches(ids[x:y] == ids[x + q : y + q])
            for s, e in zip((s_ + x).tolist(), (e_ + x).tolist(), strict=True):
                if e - s >= least:
                    runs.append((s, e + q - s, q))
                    for m in range(2 * q, (e + q - s) // 2 + 1, q):
                        known.setdefault(m, []).append((s, e + q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def repeats(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which of n words stand in a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) > 0


RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, found, texts = [], [], []
        for text in batch.column(1).cast(pa.binary()):
            words = (text.as_py() or b"").split()
            seen: dict[bytes, int] = {}
            ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
            runs = find_runs(ids)
            if runs:
                drop = repeats(runs, len(words))
                words = [words[i] for i in np.flatnonzero(~drop).tolist()]
            counts.append(len(ids))
            found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
            texts.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, RUN), pa.array(texts, pa.string())], ["_id", "n_words", "runs", "collapsed"])


def periodic_runs(documents: DataFrame, text: Column | str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period), collapsed text, for every row of documents.

    collapsed: the words that no run repeats, joined by one space.
    """
    narrow_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").alias("_id"), (F.col(text) if isinstance(text, str) else text).alias("_t"))
    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(_scan, f"_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumnRenamed("_id", "doc_id")


def planted(doc_id: Column, text: Column) -> Column:
    """The query's texts: with h = crc32(doc_id as text), g = h div 10, every tenth text repeats its words from g mod n on."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def cycle(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))), " ")

    # One-element arrays keep the split from being repeated wherever its words are named.
    cycled = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, cycle(w)).otherwise(F.lit("")))
    return F.when(h % 10 == 0, F.get(cycled, F.lit(0))).otherwise(text)


def run_digest(documents: DataFrame) -> DataFrame:
    """The query's columns: number of runs, its longest run, digests of all runs and of the collapsed text."""
    found = periodic_runs(documents, planted(F.col("doc_id"), F.col("text")))
    key = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("_best", key).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"),
        F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
