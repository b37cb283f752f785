"""Shared plumbing of the training-data operators.

* ``scratch`` / ``materialize``: lineage is cut with Parquet files in the folder
  the cluster names in ``spark.checkpoint.dir`` (never a machine-local one on a
  cluster), so a lost executor costs a re-read, not a re-run.
* ``slabs``: walks Arrow batches in byte-bounded slabs, so worker memory follows
  the longest text, not the batch.
* ``words`` / ``span_hash``: vectorised tokenising and hashing of a slab.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ship

U64 = np.uint64
SLAB_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir; a temporary one only where it is unset and the session is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, name: str, *, small: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: cut lineage, measured size, recoverable.

    small: its shuffles are not worth a garbage collection on the driver right away.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    if not small:
        release(spark)
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what materialize wrote, once nothing that is still to run reads it."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(names: list[str], *wanted: str) -> list[str]:
    """Column names that are not taken."""
    low = {n.lower() for n in names}
    out = []
    for w in wanted:
        while w.lower() in low:
            w += "_"
        low.add(w.lower())
        out.append(w)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Readies a session: ships this package and keeps Arrow batches of whole texts small unless it asks for another size."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, str(rows))


def wide(df: DataFrame, partitions: int | None = None) -> int:
    """A partition count for a stage: the session's shuffle partitions unless given."""
    return partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


@dataclass
class Slab:
    """Texts [lo, hi) of a batch as one byte array; offs has hi - lo + 1 positions in data."""

    lo: int
    hi: int
    data: np.ndarray
    offs: np.ndarray


def text_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, o, d = col.buffers()
    offs = np.frombuffer(o, dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(d, dtype=np.uint8) if d is not None and d.size else np.zeros(0, np.uint8)
    return data, offs


def slabs(col: pa.Array, limit: int = SLAB_BYTES) -> Iterator[Slab]:
    """Cuts a text column into slabs of at most `limit` bytes (one text at least)."""
    data, offs = text_parts(col)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield Slab(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(BASE))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POW: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**i (or its inverse) modulo 2**64 for i < n."""
    key = "inv" if inverse else "pow"
    if key not in _POW or len(_POW[key]) < n:
        out = np.full(max(n, SLAB_BYTES + 1024), U64(pow(BASE, -1, 1 << 64) if inverse else BASE), dtype=U64)
        out[0] = 1
        _POW[key] = np.cumprod(out)
    return _POW[key][:n]


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """h with h[j] - h[i] a position-weighted hash of data[i:j]; see span_hash."""
    h = np.zeros(len(data) + 1, dtype=U64)
    if len(data):
        np.cumsum((_BYTE[_LOWER] if lower else _BYTE)[data] * powers(len(data)), out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes, wherever it stands."""
    return mix((h[end] - h[start]) * powers(len(h), True)[start] + (end - start).astype(U64))


#: Bytes of a word: contract of the shingle and language-model operators, [^\x20\x09-\x0D]+.
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, 9, 10, 11, 12, 13]] = False


def words(slab: Slab, is_word: np.ndarray = SPACE_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each text (n texts + 1 entries)."""
    m = is_word[slab.data]
    n = len(m)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(slab.offs), np.int64)
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    cut = slab.offs[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = m[cut]
    last[cut - 1] = m[cut - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, slab.offs)


def word_hashes(slab: Slab, is_word: np.ndarray = SPACE_WORD, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the slab, and the number of words before each text."""
    start, end, before = words(slab, is_word)
    return span_hash(prefix_hash(slab.data, lower), start, end), before


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def crc_bucket(col, mod: int):
    """crc32(doc_id as text) mod `mod` as a column; a null id counts as the empty text."""
    from pyspark.sql import functions as F

    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod
