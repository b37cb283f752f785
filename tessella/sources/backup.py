"""Backup with foreign-key closure, restore and wipe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import integrity
from .tables import BACKUP_TABLES, SCHEMAS, empty

Tables = dict[str, DataFrame]


def closure(tables: Tables, tokens: list[str], *, full_history: bool = True) -> Tables:
    """All rows that the conferences named by any token need, by semi-joins alone."""
    conf, years, apps = tables["conferences"], tables["conference_years"], tables["appearances"]
    named = reduce(lambda a, b: a | b, [F.lower(F.coalesce(c, F.lit(""))).like(f"%{t.strip().lower()}%") for t in tokens for c in ("name", "canonical_name", "organizer_name")])
    seed = conf.where(named)
    seed_years = years.join(seed.select(F.col("id").alias("conference_id")), "conference_id", "left_semi")
    mine = apps.join(seed_years.select(F.col("id").alias("conference_year_id")), "conference_year_id", "left_semi")
    who = mine.select("physician_id").distinct()
    if full_history:
        mine = apps.join(who, "physician_id", "left_semi")
    year_ids = mine.select("conference_year_id").union(seed_years.select("id")).distinct()
    all_years = years.join(year_ids.withColumnRenamed("conference_year_id", "id"), "id", "left_semi")
    all_conf = conf.join(all_years.select(F.col("conference_id").alias("id")), "id", "left_semi")
    src = tables["sources"].join(year_ids, "conference_year_id", "left_semi")
    bridge = tables["run_conference_years"]
    runs = tables["scrape_runs"]
    by_bridge = bridge.join(year_ids, "conference_year_id", "left_semi").select(F.col("run_id").alias("id"))
    by_conf = runs.join(all_conf.select(F.col("id").alias("conference_id")), "conference_id", "left_semi").select("id")
    run_ids = by_bridge.union(by_conf).distinct()
    of_runs = run_ids.withColumnRenamed("id", "run_id")
    return {
        "conferences": all_conf,
        "conference_years": all_years,
        "sources": src,
        "physicians": tables["physicians"].join(who.withColumnRenamed("physician_id", "id"), "id", "left_semi"),
        "physician_aliases": tables["physician_aliases"].join(who, "physician_id", "left_semi"),
        "extractions": tables["extractions"].join(src.select(F.col("id").alias("source_id")), "source_id", "left_semi"),
        "appearances": mine,
        "scrape_runs": runs.join(run_ids, "id", "left_semi"),
        "run_conference_years": bridge.join(of_runs, "run_id", "left_semi"),
        "run_events": tables["run_events"].join(of_runs, "run_id", "left_semi"),
    }


def digest(df: DataFrame, name: str) -> DataFrame:
    """(table_name, rows, sha256): order-free digest, the hash of the sorted row hashes' exclusive parts summed by prefix."""
    cols = [c.split()[0] for c in SCHEMAS[name].split(", ")]
    rows = df.select(F.sha2(F.to_json(F.struct(*cols)), 256).alias("h"))
    # 256 partial digests keep the sort bounded; they are combined in one row.
    parts = rows.groupBy(F.substring("h", 1, 2).alias("p")).agg(F.count("*").alias("n"), F.sum(F.conv(F.substring("h", 3, 12), 16, 10).cast("decimal(38,0)")).alias("s"))
    text = F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("p", "n", "s"))), lambda x: F.concat_ws(":", x["p"], x["n"].cast("string"), x["s"].cast("string"))))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(text, 256).alias("sha256")).select(F.lit(name).alias("table_name"), "rows", "sha256")


def manifest(tables: Tables) -> DataFrame:
    return reduce(DataFrame.unionByName, [digest(tables[t], t) for t in BACKUP_TABLES])


def export(tables: Tables, folder: str) -> None:
    """Every table as JSON lines, and a manifest of counts and digests."""
    for name in BACKUP_TABLES:
        tables[name].write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/{name}")
    manifest(tables).coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")


def restore(spark: SparkSession, folder: str) -> Tables:
    """Tables of a backup; a missing one is empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    out: Tables = {}
    for name in BACKUP_TABLES:
        path = hadoop.Path(f"{folder}/{name}")
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        out[name] = spark.read.schema(SCHEMAS[name]).json(f"{folder}/{name}") if there else empty(spark, name)
    return out


def reload(spark: SparkSession, folder: str) -> tuple[Tables, DataFrame, DataFrame]:
    """A backup as it is loaded: tables in the order of their foreign keys without orphans, the sequences after it, and counts."""
    given = restore(spark, folder)
    loaded = integrity.ordered(given)
    return loaded, integrity.sequences(loaded), integrity.orphans(given)


def next_ids(tables: Tables) -> dict[str, int]:
    """The id that follows each table's largest."""
    return {r["table_name"]: r["next_id"] for r in integrity.sequences(tables).collect()}


def wipe(spark: SparkSession) -> Tables:
    return {name: empty(spark, name) for name in BACKUP_TABLES}
