"""Run control as aggregates: counters, states of years and runs, targets of records, pages of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T

PAYLOAD = "struct<counters: map<string, bigint>, metrics: map<string, bigint>, gauges: map<string, bigint>>"


def metrics(events: DataFrame, run: str, order: str, data: str, branches: DataFrame) -> DataFrame:
    """(run, metric, value): every metric of every run, 0 where nothing was told.

    events: counters and metrics in the payload are increments, gauges are states of
    which the last counts.  branches: (run, new_people, linked) of each branch; one
    with either is of high yield.  All increments are summed before a shuffle.
    """
    told = events.select(run, order, F.from_json(data, PAYLOAD).alias("p"))

    def entries(kind: str) -> Column:
        given = F.coalesce(F.col(f"p.{kind}"), F.create_map().cast("map<string, bigint>"))
        return F.transform(F.map_entries(given), lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].alias("name"), e["value"].alias("v")))

    pairs = F.concat(*[entries(kind) for kind in ("counters", "metrics", "gauges")])
    each = told.select(run, order, F.explode(pairs).alias("e")).select(run, order, "e.*").where("v IS NOT NULL")
    sums = each.groupBy(run, "kind", "name").agg(F.sum("v").alias("total"), F.max_by("v", order).alias("last"))
    value = F.when(F.col("kind") == "gauges", F.col("last")).otherwise(F.col("total"))
    names = F.create_map(*[F.lit(x) for pair in K.COUNTED_METRICS.items() for x in pair])
    known = sums.select(run, F.when(F.col("kind") == "counters", F.element_at(names, F.col("name"))).otherwise(F.col("name")).alias("metric"), value.alias("value"))
    high = branches.groupBy(run).agg(F.count_if((F.col("new_people") > 0) | (F.col("linked") > 0)).alias("value")).select(run, F.lit("high_yield_branches").alias("metric"), "value")
    base = events.select(run).distinct().select(run, F.explode(F.array(*[F.lit(m) for m in K.RUN_METRICS])).alias("metric"), F.lit(0).cast("bigint").alias("value"))
    every = known.where(F.col("metric").isin(K.RUN_METRICS) & (F.col("metric") != "high_yield_branches")).unionByName(high).unionByName(base)
    return every.groupBy(run, "metric").agg(F.sum("value").alias("value"))


def year_status(linked: Column, duplicates: Column) -> Column:
    """(status, notes) of a discovered year."""
    return F.when(linked > 0, F.struct(F.lit("complete").alias("status"), F.concat(F.lit("Linked "), linked.cast("string"), F.lit(" physician appearance(s)")).alias("notes"))).when(
        duplicates > 0, F.struct(F.lit("partial").alias("status"), F.lit("Only duplicate appearance records found").alias("notes"))
    ).otherwise(F.struct(F.lit("partial").alias("status"), F.lit("Conference-year discovered but no attributable physician links").alias("notes")))


def run_status(years: DataFrame, runs: DataFrame, run: str) -> DataFrame:
    """runs (run, cancelled, stalled, blocked_pages) with their final status and message.

    years: (run, linked, duplicates) of every discovered year.  The ladder: cancelled,
    stalled, nothing found (blocked or not), all years complete, some of either kind.
    """
    y = years.withColumn("status", year_status(F.col("linked"), F.col("duplicates"))["status"])
    found = y.groupBy(run).agg(F.count("*").alias("n"), F.sum("linked").alias("all_linked"), F.count_if(F.col("status") == "partial").alias("partial"))
    n = F.coalesce("n", F.lit(0))
    ladder = (
        F.when(F.col("cancelled"), F.struct(F.lit("partial").alias("status"), F.lit("Cancelled by user").alias("message")))
        .when(F.col("stalled"), F.struct(F.lit("partial").alias("status"), F.lit("Run terminated after repeated normalization stalls").alias("message")))
        .when((n == 0) & (F.col("blocked_pages") > 0), F.struct(F.lit("partial").alias("status"), F.lit("No attributable conference-years found; sources were blocked or inconclusive").alias("message")))
        .when(n == 0, F.struct(F.lit("error").alias("status"), F.lit("No attributable conference-years discovered").alias("message")))
        .when((F.col("all_linked") > 0) & (F.col("partial") == 0), F.struct(F.lit("complete").alias("status"), F.lit(None).cast("string").alias("message")))
        .otherwise(F.struct(F.lit("partial").alias("status"), F.lit(None).cast("string").alias("message")))
    )
    return runs.join(found, run, "left").withColumn("_s", ladder).select(*runs.columns, n.cast("long").alias("years"), F.col("_s.status").alias("status"), F.col("_s.message").alias("message"))


def transitions(events: DataFrame, run: str, order: str, stage: Column) -> DataFrame:
    """State of a run after each event: pending, running once a fetch begins, then the first terminal stage for good."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = F.first(F.when(stage.isin(*K.TERMINAL_STAGES), stage), ignorenulls=True).over(w)
    begun = F.max(stage.isin(*K.RUNNING_STAGES).cast("int")).over(w)
    return events.withColumn("state", F.coalesce(ended, F.when(begun == 1, "running").otherwise("pending")))


def valid(target: Column) -> Column:
    return (F.trim(F.coalesce(target["name"], F.lit(""))) != "") & target["year"].between(1990, 2100)


def targets(records: DataFrame, explicit: Column, found: Column, known: Column, url: Column, hint: Column) -> DataFrame:
    """records with the rung that gave them targets and one row a target; unresolved ones keep one row without.

    Rungs: the record's own valid targets; those of the batch; the first known target
    of the largest year in the address; the only known target.  A conference that the
    run is about replaces the target's name.
    """
    picked = lambda t: F.filter(F.coalesce(t, F.array().cast(KIND)), valid)
    year = F.array_max(T.years(url))
    of_year = F.slice(F.filter(known, lambda t: t["year"] == year), 1, 1)
    only = F.when(F.size(known) == 1, known).otherwise(F.slice(known, 1, 0))
    rungs = F.array(*[F.struct(F.lit(name).alias("rung"), t.alias("targets")) for name, t in (("explicit", picked(explicit)), ("batch", picked(found)), ("url_year", of_year), ("only_known", only))])
    first = F.coalesce(F.get(F.filter(rungs, lambda r: F.size(r["targets"]) > 0), F.lit(0)), F.struct(F.lit("unresolved").alias("rung"), F.array().cast(KIND).alias("targets")))
    chosen = records.withColumn("_r", first)
    each = chosen.select(*records.columns, F.col("_r.rung").alias("rung"), F.explode_outer("_r.targets").alias("_t"))
    name = F.coalesce(F.nullif(F.trim(hint), F.lit("")), F.col("_t.name"))
    return each.select(*records.columns, "rung", F.when(F.col("_t").isNotNull(), name).alias("conference"), F.col("_t.year").alias("year"), F.col("_t.confidence").alias("target_confidence"))


KIND = "array<struct<name: string, year: int, confidence: double>>"


def links(assigned: DataFrame, stored: DataFrame, keys: list[str], order: str) -> DataFrame:
    """assigned with `outcome`: unresolved, duplicate (a stored or an earlier row has its keys, nulls equal) or linked."""
    w = Window.partitionBy(*keys).orderBy(order, "rung")
    there = stored.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn("_there", F.lit(True))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    seen = assigned.withColumn("_nth", F.row_number().over(w)).join(there, on, "left")
    outcome = F.when(F.col("rung") == "unresolved", "unresolved").when(F.col("_there") | (F.col("_nth") > 1), "duplicate").otherwise("linked")
    return seen.withColumn("outcome", outcome).select(*assigned.columns, "outcome")


def event_pages(events: DataFrame, run: str, order: str, limit: int) -> DataFrame:
    """Every page that a reader of a run's events gets, `limit` a page, with the cursor of the next request."""
    n = F.row_number().over(Window.partitionBy(run).orderBy(order)) - 1
    paged = events.withColumn("page", F.floor(n / limit).cast("int"))
    return paged.groupBy(run, "page").agg(F.count("*").alias("events"), F.min(order).alias("first_id"), F.max(order).alias("next_cursor"))
