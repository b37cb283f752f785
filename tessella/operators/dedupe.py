"""De-duplication policies.  Every policy names its order, so results don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str | Column], order: list[Column], keep: int = 1) -> DataFrame:
    """The first `keep` rows of each key in the given order (a local limit runs before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn")


def last_value(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """One row a key: the place of its first row with the values of its last; one aggregate, no window."""
    rest = [c for c in df.columns if c not in keys and c != position]
    last = F.max_by(F.struct(*rest), F.col(position))
    return df.groupBy(*keys).agg(F.min(position).alias(position), last.alias("_v")).select(*keys, position, *[F.col(f"_v.{c}").alias(c) for c in rest])


def seen_before(df: DataFrame, key: Column, order: list[Column], within: list[str] | None = None) -> DataFrame:
    """Adds `seen`: whether an earlier row has the same key."""
    return df.withColumn("seen", F.row_number().over(Window.partitionBy(*(within or []), key).orderBy(*order)) > 1)


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key (nulls equal) isn't there yet, one for each key."""
    on = None
    e, i = existing.select(*keys).alias("e"), incoming.alias("i")
    for k in keys:
        c = F.col(f"i.{k}").eqNullSafe(F.col(f"e.{k}"))
        on = c if on is None else on & c
    return i.join(e, on, "left_anti").dropDuplicates(keys)


def fill_null(base: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with its null columns filled from other."""
    o = other.select(key, *[F.col(c).alias(f"_o_{c}") for c in columns])
    joined = base.join(o, key, "left")
    return joined.select(*[F.coalesce(c, f"_o_{c}").alias(c) if c in columns else c for c in base.columns])


def upsert(stored: DataFrame, incoming: DataFrame, key: str, order: str, keep_max: list[str], fill: list[str]) -> DataFrame:
    """One row a key of both tables: the greatest of each keep_max column, the first non-null of each fill column.

    Stored rows come before incoming ones, each in the given order; one aggregate, no join.
    """
    cols = [key, order, *keep_max, *fill]
    rows = stored.select(*cols, F.lit(0).alias("_from")).unionByName(incoming.select(*cols, F.lit(1).alias("_from")))
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("_from", order))).alias(c) for c in fill]
    return rows.groupBy(key).agg(*[F.max(c).alias(c) for c in keep_max], *firsts, (F.min("_from") == 0).alias("stored"))


def ordered_union(sources: list[DataFrame], keys: list[str], position: str) -> DataFrame:
    """Rows of all sources, the first of each key: earlier sources win, then the smaller position."""
    out = None
    for i, df in enumerate(sources):
        part = df.withColumn("source", F.lit(i))
        out = part if out is None else out.unionByName(part)
    rest = [c for c in out.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct("source", position))
    return out.groupBy(*keys).agg(best.alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])
