"""Rolling sums, streaks, budgets and rate limits as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_sum(df: DataFrame, value: Column, key: list[str], order: str, rows: int, out: str, inclusive: bool = True) -> DataFrame:
    """Sum over the last `rows` rows (before this one, unless inclusive) and how many there were, as out and out_n."""
    lo, hi = (-(rows - 1), 0) if inclusive else (-rows, -1)
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(lo, hi)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0))).withColumn(f"{out}_n", F.count(F.lit(1)).over(w))


def streak(df: DataFrame, hit: Column, key: list[str], order: str, out: str) -> DataFrame:
    """Length of the run of rows without a hit that ends here (0 on a hit): gaps and islands."""
    w = Window.partitionBy(*key).orderBy(order)
    marked = df.withColumn("_island", F.sum(hit.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_miss", (~hit).cast("int"))
    inside = Window.partitionBy(*key, "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn(out, F.sum("_miss").over(inside)).drop("_island", "_miss")


def budget(df: DataFrame, candidates: str, appearances: str, key: list[str], order: str, soft: int = 16, hard: int = 120, step: int = 8, rows: int = 5) -> DataFrame:
    """Page budget before each page: a full trailing window with 10 candidates or 3 appearances adds a step."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(-rows, -1)
    grow = (F.count(F.lit(1)).over(w) == rows) & ((F.sum(candidates).over(w) >= 10) | (F.sum(appearances).over(w) >= 3))
    upto = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("expands", F.coalesce(grow, F.lit(False)).cast("int")).withColumn("budget", F.least(F.lit(hard), soft + step * F.sum("expands").over(upto)))


def minute_rate(df: DataFrame, key: list[str], ts: str, limit: int = 10) -> DataFrame:
    """Requests in the 60 seconds up to each one (one exactly 60 s old is out), and whether they exceed the limit."""
    w = Window.partitionBy(*key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-59_999_999, 0)
    return df.withColumn("in_minute", F.count(F.lit(1)).over(w)).withColumn("over_limit", F.col("in_minute") > limit)


def zero_windows(df: DataFrame, measure: Column, key: list[str], order: str, rows: int = 10, limit: int = 3) -> DataFrame:
    """Full trailing windows without any novelty, their streak, and whether the streak reaches the limit."""
    rolled = rolling_sum(df, measure, key, order, rows, "novel")
    idle = (F.col("novel_n") == rows) & (F.col("novel") == 0)
    return streak(rolled, ~idle, key, order, "zero_windows").withColumn("stops", F.col("zero_windows") >= limit)


def carry_forward(df: DataFrame, value: Column, key: list[str], order: str, out: str) -> DataFrame:
    """The latest non-null value so far."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def distinct_so_far(df: DataFrame, item: Column, key: list[str], order: str, out: str) -> DataFrame:
    """Distinct items up to and with each row."""
    firsts = df.withColumn("_item", item).withColumn("_new", (F.row_number().over(Window.partitionBy(*key, "_item").orderBy(order)) == 1).cast("int"))
    return firsts.withColumn(out, F.sum("_new").over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))).drop("_item", "_new")


def interactions(df: DataFrame, added: Column, delta: Column, key: list[str], order: str, least: int = 180, limit: int = 3) -> DataFrame:
    """Actions up to the one that ends a run of `limit` without novelty (new links, or enough new text)."""
    marked = streak(df.withColumn("novel", (added > 0) | (delta >= least)), F.col("novel"), key, order, "streak")
    before = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return marked.withColumn("_ended", F.coalesce(F.max((F.col("streak") >= limit).cast("int")).over(before), F.lit(0))).where("_ended = 0").drop("_ended")


def watchdog(df: DataFrame, key: list[str], ts: str, order: str, seconds: int = 240, most: int = 2) -> DataFrame:
    """Adds stalled (more than `seconds` since the row before), how often so far, and whether that ends the run."""
    w = Window.partitionBy(*key).orderBy(order)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(w)
    marked = df.withColumn("stalled", F.coalesce(gap > seconds * 1_000_000, F.lit(False)))
    return marked.withColumn("stalls", F.sum(F.col("stalled").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("terminal", F.col("stalls") >= most)


def unanimous(df: DataFrame, key: list[str], vote: Column, links: Column, reason: Column, order: str) -> DataFrame:
    """stop: every segment votes for it and none has links; reason: the last non-empty one."""
    return df.groupBy(*key).agg(
        (F.coalesce(F.bool_and(F.coalesce(vote, F.lit(False))), F.lit(False)) & (F.coalesce(F.sum(links), F.lit(0)) == 0)).alias("stop"),
        F.max_by(reason, F.when(F.coalesce(reason, F.lit("")) != "", F.col(order))).alias("reason"),
    )
