"""Queries of loads by foreign keys, dense ids, schema versions and re-keyed rows, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linkage
from ..sources import integrity
from .marts import read

KEYS = {
    "conferences": {},
    "conference_years": {"conference_id": "conferences"},
    "physicians": {},
    "appearances": {"physician_id": "physicians", "conference_year_id": "conference_years"},
    "run_events": {"conference_year_id": "conference_years"},
}


def _model(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """Nations, their years, customers, orders and events as the model's tables, with parents missing here and there."""
    c = read(s, d, "customer")
    o = read(s, d, "orders").join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    year = (F.col("c_nationkey") * 10000 + F.year("o_orderdate")).cast("long")
    e = read(s, d, "events")
    return {
        "conferences": read(s, d, "nation").where("n_nationkey % 6 != 5").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")),
        "conference_years": o.select(year.alias("id"), F.col("c_nationkey").cast("long").alias("conference_id")).distinct(),
        "physicians": c.where("c_custkey % 10 != 3").select((F.col("c_custkey") * 7).cast("long").alias("id"), F.col("c_name").alias("full_name")),
        "appearances": o.select(F.col("o_orderkey").cast("long").alias("id"), (F.col("o_custkey") * 7).cast("long").alias("physician_id"), year.alias("conference_year_id")),
        "run_events": e.select(F.col("event_id").cast("long").alias("id"), F.when(F.col("event_id") % 3 != 0, F.col("user_id") % 25 * 10000 + 1992 + F.col("event_id") % 9).cast("long").alias("conference_year_id")),
    }


def load_orphans(s: SparkSession, d: str) -> DataFrame:
    return integrity.orphans(_model(s, d), KEYS)


def load_sequences(s: SparkSession, d: str) -> DataFrame:
    return integrity.sequences(integrity.ordered(_model(s, d), KEYS))


def dense_references(s: SparkSession, d: str) -> DataFrame:
    """Appearances after a load that numbers every table anew."""
    return integrity.renumbered(_model(s, d), KEYS)["appearances"]


def schema_upgrade(s: SparkSession, d: str) -> DataFrame:
    """Customers as people of the first schema version, brought to the last one."""
    people = read(s, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("full_name"), F.lower("c_name").alias("name_key"), F.lit("MD").alias("primary_designation"), F.col("c_mktsegment").alias("primary_affiliation"), F.lit(None).cast("string").alias("primary_location"), F.lit(None).cast("timestamp").alias("created_at"))
    first = {t: s.createDataFrame([], ", ".join(f"{c} {integrity._types(t)[c]}" for c in names)) for t, names in integrity.columns_at(1).items()}
    up = integrity.upgrade(first | {"physicians": people}, 1)["physicians"]
    return up.select("id", "full_name", "primary_affiliation", "primary_specialty", "photo_url", "enrichment_confidence", F.lit(len(up.columns)).alias("columns"))


def rekeyed_rows(s: SparkSession, d: str) -> DataFrame:
    """Orders after customers were merged in fives; rows that become equal in person, priority and day collapse."""
    o = read(s, d, "orders").select(F.col("o_custkey").cast("long").alias("o_custkey"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("session"), F.year("o_orderdate").alias("year"))
    mapping = read(s, d, "customer").where("c_custkey % 5 != 0").select(F.col("c_custkey").cast("long").alias("id"), (F.col("c_custkey") - F.col("c_custkey") % 5).cast("long").alias("target"))
    return linkage.rekey(o, "o_custkey", mapping, ["o_custkey", "session", "year"])


QUERIES = {f.__name__: f for f in (load_orphans, load_sequences, dense_references, schema_upgrade, rekeyed_rows)}

_LOAD = """
o AS (SELECT o_orderkey, o_custkey, c_nationkey, c_nationkey * 10000 + year(o_orderdate) AS y FROM orders JOIN customer ON o_custkey = c_custkey),
c0 AS (SELECT n_nationkey AS id FROM nation WHERE n_nationkey % 6 <> 5), y0 AS (SELECT DISTINCT y AS id, c_nationkey AS conference_id FROM o),
p0 AS (SELECT c_custkey * 7 AS id FROM customer WHERE c_custkey % 10 <> 3), a0 AS (SELECT o_orderkey AS id, o_custkey * 7 AS physician_id, y AS conference_year_id FROM o),
e0 AS (SELECT event_id AS id, CASE WHEN event_id % 3 <> 0 THEN user_id % 25 * 10000 + 1992 + event_id % 9 END AS conference_year_id FROM events),
y1 AS (SELECT * FROM y0 WHERE conference_id IN (SELECT id FROM c0)), a1 AS (SELECT * FROM a0 WHERE physician_id IN (SELECT id FROM p0) AND conference_year_id IN (SELECT id FROM y1)),
e1 AS (SELECT * FROM e0 WHERE conference_year_id IS NULL OR conference_year_id IN (SELECT id FROM y1))"""
_PAIRS = (("conferences", "c0", "c0"), ("conference_years", "y0", "y1"), ("physicians", "p0", "p0"), ("appearances", "a0", "a1"), ("run_events", "e0", "e1"))

ORACLES = {
    "load_orphans": f"WITH {_LOAD} " + " UNION ALL ".join(f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {a}) AS rows, (SELECT count(*) FROM {b}) AS loaded, (SELECT count(*) FROM {a}) - (SELECT count(*) FROM {b}) AS orphans" for t, a, b in _PAIRS),
    "load_sequences": f"WITH {_LOAD} " + " UNION ALL ".join(f"SELECT '{t}' AS table_name, coalesce(max(id), 1) AS last_value, count(*) > 0 AS is_called, coalesce(max(id) + 1, 1) AS next_id FROM {b}" for t, _, b in _PAIRS),
    "dense_references": f"WITH {_LOAD}, y2 AS (SELECT id, row_number() OVER (ORDER BY id) AS new FROM y1), p2 AS (SELECT id, row_number() OVER (ORDER BY id) AS new FROM p0) SELECT row_number() OVER (ORDER BY a1.id) AS id, p2.new AS physician_id, y2.new AS conference_year_id FROM a1 JOIN p2 ON physician_id = p2.id JOIN y2 ON conference_year_id = y2.id",
    "schema_upgrade": "SELECT c_custkey AS id, c_name AS full_name, c_mktsegment AS primary_affiliation, CAST(NULL AS VARCHAR) AS primary_specialty, CAST(NULL AS VARCHAR) AS photo_url, CAST(NULL AS DOUBLE) AS enrichment_confidence, 16 AS columns FROM customer",
    "rekeyed_rows": "SELECT DISTINCT CASE WHEN o_custkey % 5 <> 0 THEN o_custkey - o_custkey % 5 ELSE o_custkey END AS o_custkey, nullif(o_orderpriority, '5-LOW') AS session, year(o_orderdate) AS year FROM orders",
}
