"""Approximate nearest neighbours with cross-polytope hashing.

Each table turns unit vectors with three sign-flip + fast-Hadamard rounds and
assigns them to the nearest signed axis; queries probe the axes with the largest
projections (multiprobe).  Candidates are reranked exactly, in double precision,
on the original vectors inside each bucket, and only a query's best few leave it.

Equal vectors are collapsed to one class that carries its smallest ids, so a hot
vector costs one candidate; buckets are cut into id-hashed slices of bounded size
and a query visits every slice.  Queries for which probing finds too few rows
probe every axis, which is exhaustive.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null vec_id, take no part; repeated (vec_id, vector)
rows count once; vectors of another length are never neighbours; ties go to the
smaller vec_id; with fewer candidates than k all are returned; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, narrow_batches


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (length a power of two), orthonormal."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def axis_codes(x: np.ndarray, table: int, probes: int, seed: int) -> np.ndarray:
    """The `probes` best signed axes of each row in a table: 2 * axis + (1 if negative)."""
    d = 1 << max(0, int(x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
    for signs in np.random.default_rng([seed, table, d]).choice([-1.0, 1.0], (3, d)):
        y = hadamard(y * signs)
    both = np.stack([y, -y], axis=2).reshape(len(x), 2 * d)
    k = min(probes, 2 * d)
    if k == 1:
        return both.argmax(axis=1)[:, None]
    top = np.argpartition(-both, k - 1, axis=1)[:, :k] if k < 2 * d else np.tile(np.arange(2 * d), (len(x), 1))
    return top


def _valid(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs = batch.column(0).to_pylist(), batch.column(1)
            keep_id, keep_vec = [], []
            if len(ids):
                flat = vecs.flatten()
                ok = np.asarray(flat.is_valid())
                val = np.asarray(flat.fill_null(0)).astype(kind)
                length = np.asarray(vecs.value_lengths().fill_null(0))
                end = np.cumsum(length)
                for i, n, e in zip(ids, length.tolist(), end.tolist(), strict=True):
                    v = val[e - n : e]
                    if i is not None and n and ok[e - n : e].all() and np.isfinite(v).all() and v.any():
                        keep_id.append(i)
                        keep_vec.append((v + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keep_id, pa.int64()), pa.array(keep_vec, pa.binary())], ["vec_id", "vec"])

    return run


def _matrix(vecs: list[bytes], kind: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and double matrices by vector length."""
    size = np.array([len(v) for v in vecs])
    return {int(n): (np.flatnonzero(size == n), np.frombuffer(b"".join(v for v in vecs if len(v) == n), kind).reshape(-1, int(n) // np.dtype(kind).itemsize).astype(np.float64)) for n in np.unique(size)}


_CODED = "tab int, code long, cid long, low long, vec binary"


def _code(kind: str, tables: int, probes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(2).to_pylist()
            for n, (rows, x) in (_matrix(vecs, kind) if vecs else {}).items():
                part = batch.take(pa.array(rows))
                for t in range(tables):
                    codes = axis_codes(x, t, probes, seed)
                    at = np.repeat(np.arange(len(rows)), codes.shape[1])
                    out = part.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(codes.ravel().astype(np.int64) + (n << 20)), out.column(0), out.column(1), out.column(2)], ["tab", "code", "cid", "low", "vec"])

    return run


def _search(kind: str, keep: int):
    def run(group: pa.Table) -> pa.Table:
        is_query = np.asarray(group["is_query"])
        cid, low = np.asarray(group["cid"]), np.asarray(group["low"])
        q_at, c_at = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        out: list[tuple[np.ndarray, ...]] = []
        if len(q_at) and len(c_at):
            vecs = group["vec"].to_pylist()
            width = len(vecs[0])
            x = np.frombuffer(b"".join(vecs), kind).reshape(-1, width // np.dtype(kind).itemsize).astype(np.float64)
            c, norm = x[c_at], (x[c_at] ** 2).sum(1)
            for i in range(0, len(q_at), 256):
                block = q_at[i : i + 256]
                near = norm[None] - 2 * x[block] @ c.T
                k = min(keep, len(c_at))
                edge = np.partition(near, k - 1, axis=1)[:, k - 1 : k]
                scale = 1e-9 * (1 + np.abs(norm).max() + (x[block] ** 2).sum(1)[:, None])
                r, j = np.nonzero(near <= edge + scale)  # all that exact arithmetic could rank among the best
                d = np.sqrt(((x[block[r]] - c[j]) ** 2).sum(1))
                o = np.lexsort((low[c_at[j]], d, r))
                r, j, d = r[o], j[o], d[o]
                rank = np.arange(len(r)) - np.searchsorted(r, r)
                m = rank < keep
                out.append((cid[block[r[m]]], cid[c_at[j[m]]], low[c_at[j[m]]], d[m]))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        return pa.table({"qcid": cols[0], "cid": cols[1], "low": cols[2], "score": cols[3]})

    return run


def neighbours(vectors: DataFrame, is_query, *, k: int = 10, tables: int = 8, probes: int = 20, slice_rows: int = 20_000, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found for each row where is_query holds."""
    narrow_batches(vectors.sparkSession)
    kind = "<f8" if "double" in vectors.schema["embedding"].dataType.simpleString() else "<f4"
    rows = materialize(vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_valid(kind), "vec_id long, vec binary").dropDuplicates(["vec_id", "vec"]), "ann-rows")
    keep = k + 1  # a class, and the query's own row among them
    first = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("_rn") <= keep)
    classes = materialize(first.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.xxhash64("vec").alias("cid"), F.element_at("ids", 1).alias("low"), "vec", "ids"), "ann-classes")
    queries = materialize(rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.xxhash64("vec").alias("qcid")), "ann-queries")
    asked = queries.select(F.col("qcid").alias("cid")).distinct()

    def search(asked: DataFrame, probes: int, tables: int) -> DataFrame:
        side = classes.join(asked, "cid", "left_semi").select("cid", "low", "vec")
        slices = max(1, -(-classes.count() // (64 * slice_rows)))
        data = classes.select("cid", "low", "vec").mapInArrow(_code(kind, tables, 1, seed), _CODED).withColumn("slice", F.pmod("cid", F.lit(slices))).withColumn("is_query", F.lit(False))
        ask = side.mapInArrow(_code(kind, tables, probes, seed), _CODED).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<long>"))).withColumn("is_query", F.lit(True))
        hits = data.unionByName(ask).groupBy("tab", "code", "slice").applyInArrow(_search(kind, keep), "qcid long, cid long, low long, score double")
        best = hits.dropDuplicates(["qcid", "cid"]).withColumn("_rn", F.row_number().over(Window.partitionBy("qcid").orderBy("score", "low"))).where(F.col("_rn") <= keep)
        named = best.join(classes.select("cid", "ids"), "cid").select("qcid", F.expr("transform(ids, i -> struct(score AS score, i AS vec_id, cid = qcid AS same))").alias("near"))
        return materialize(named.groupBy("qcid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, keep).alias("near")), "ann-found")

    found = search(asked, probes, tables)
    few = asked.join(found.where(F.size("near") >= keep).select(F.col("qcid").alias("cid")), "cid", "left_anti")
    few = materialize(few, "ann-few")
    if not few.isEmpty():
        again = search(few, 1 << 20, 1)
        found = found.join(few.withColumnRenamed("cid", "qcid"), "qcid", "left_anti").unionByName(again)
    near = F.slice(F.expr("filter(near, x -> NOT (x.same AND x.vec_id = query_id))"), 1, k)
    return queries.join(found, "qcid").select("query_id", F.posexplode(near).alias("_p", "_n")).select("query_id", (F.col("_p") + 1).cast("int").alias("rank"), F.col("_n.vec_id").alias("vec_id"), F.col("_n.score").alias("score"))
