"""The overview of finished runs: figures from run logs where a run has one, from its events else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States of finished runs.
FINISHED = ["complete", "partial", "error"]


def named(name: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("Unknown"))


def log_figures(logs: DataFrame) -> DataFrame:
    """Pages, pages with records and distinct links of each log (run_id, urls as tables.run_logs reads them)."""
    links = F.filter(F.transform(F.flatten(F.transform("urls", lambda u: F.coalesce(u["nav_next_urls"], F.array().cast("array<string>")))), lambda u: F.trim(u)), lambda u: u != "")
    good = F.size(F.filter("urls", lambda u: u["normalized_records"] > 0))
    return logs.where("urls is not null").select("run_id", F.size("urls").alias("log_pages"), good.alias("log_good"), F.array_distinct(links).alias("links"))


def run_figures(runs: DataFrame, events: DataFrame, logs: DataFrame) -> DataFrame:
    """One row for each finished run with an extraction: speakers, pages, good pages and links.

    runs (run_id, conference_name, status), events (run_id, stage, speakers not negative),
    logs one row a run at most.  Runs without speakers count no pages and no links.
    """
    ended = F.col("stage") == "markdown_extract_end"
    seen = events.groupBy("run_id").agg(F.count_if(ended).alias("extracts"), F.sum(F.when(ended, F.col("speakers")).otherwise(0)).alias("speakers"), F.count_if(F.col("stage") == "fetch_route").alias("routes"), F.count_if(ended & (F.col("speakers") > 0)).alias("good"))
    done = runs.where(F.col("status").isin(FINISHED)).select("run_id", named(F.col("conference_name")).alias("conference"))
    r = done.join(seen.where("extracts > 0"), "run_id").join(log_figures(logs), "run_id", "left")
    counted = lambda c: F.when(F.col("speakers") > 0, c)
    zero = lambda *c: F.coalesce(counted(F.coalesce(*c)), F.lit(0)).cast("long")
    return r.select("run_id", "conference", "speakers", zero("log_pages", "routes").alias("pages"), zero("log_good", "good").alias("good"), counted(F.col("links")).alias("links"))


def _covered(runs: DataFrame, run_years: DataFrame, years: DataFrame) -> DataFrame:
    """Conference years (conference_year_id, conference) that a finished run covers."""
    done = runs.where(F.col("status").isin(FINISHED))
    return years.join(run_years.join(done, "run_id", "left_semi"), "conference_year_id", "left_semi").select("conference_year_id", named(F.col("conference_name")).alias("conference"))


def by_conference(runs: DataFrame, run_years: DataFrame, years: DataFrame, appearances: DataFrame, events: DataFrame, logs: DataFrame) -> DataFrame:
    """One row for each conference with an extraction.

    run_years (run_id, conference_year_id), years (conference_year_id, conference_name),
    appearances (conference_year_id, physician_id).
    """
    figures, covered = run_figures(runs, events, logs), _covered(runs, run_years, years)
    sums = figures.groupBy("conference").agg(*[F.sum(c).alias(c) for c in ("speakers", "pages", "good")])
    links = figures.select("conference", F.explode("links").alias("link")).groupBy("conference").agg(F.count_distinct("link").alias("links"))
    scraped = covered.groupBy("conference").agg(F.count("*").alias("years"))
    stored = appearances.join(covered, "conference_year_id").groupBy("conference").agg(F.count("*").alias("appearances"), F.count_distinct("physician_id").alias("people"))
    out = sums.join(links, "conference", "left").join(scraped, "conference", "left").join(stored, "conference", "left")
    return out.select("conference", "speakers", "pages", "good", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("links", "years", "appearances", "people")])


def totals(runs: DataFrame, run_years: DataFrame, years: DataFrame, appearances: DataFrame, events: DataFrame, logs: DataFrame) -> DataFrame:
    """One row over everything; links and people count once across conferences."""
    figures, covered = run_figures(runs, events, logs), _covered(runs, run_years, years)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    sums = figures.agg(F.count_if(F.col("speakers") > 0).alias("runs"), F.count_distinct("conference").alias("conferences"), zero("speakers"), zero("pages"), zero("good"))
    links = figures.select(F.explode("links").alias("link")).agg(F.count_distinct("link").alias("links"))
    stored = appearances.join(covered, "conference_year_id", "left_semi").agg(F.count("*").alias("appearances"), F.count_distinct("physician_id").alias("people"))
    # Four tables of one row each.
    return sums.crossJoin(links).crossJoin(covered.agg(F.count("*").alias("years"))).crossJoin(stored)
