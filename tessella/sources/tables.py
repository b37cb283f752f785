"""The relational model: schemas of its eleven tables, and loading with checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS: dict[str, str] = {
    "conferences": "id bigint NOT NULL, name string NOT NULL, canonical_name string, organizer_name string, event_series_name string, name_confidence double, created_at timestamp NOT NULL",
    "conference_years": "id bigint NOT NULL, conference_id bigint NOT NULL, year int NOT NULL, status string NOT NULL, notes string, created_at timestamp NOT NULL",
    "sources": "id bigint NOT NULL, conference_year_id bigint NOT NULL, url string NOT NULL, category string NOT NULL, method string NOT NULL, fetch_status string NOT NULL, http_status int, content_type string, score double, created_at timestamp NOT NULL",
    "physicians": "id bigint NOT NULL, full_name string NOT NULL, name_key string NOT NULL, primary_designation string, primary_affiliation string, primary_location string, primary_specialty string, primary_education string, primary_profile_url string, photo_url string, photo_source_url string, bio_short string, bio_source_url string, enrichment_confidence double, enrichment_updated_at timestamp, created_at timestamp NOT NULL",
    "physician_aliases": "id bigint NOT NULL, physician_id bigint NOT NULL, alias string NOT NULL, alias_key string NOT NULL",
    "extractions": "id bigint NOT NULL, source_id bigint NOT NULL, artifact_type string NOT NULL, data string NOT NULL, created_at timestamp NOT NULL",
    "appearances": "id bigint NOT NULL, physician_id bigint NOT NULL, conference_year_id bigint NOT NULL, role string, session_title string, talk_brief_extracted string, talk_brief_generated string, confidence double, source_url string",
    "scrape_runs": "id string NOT NULL, home_url string NOT NULL, conference_name string, conference_id bigint, start_year int, end_year int, status string NOT NULL, error_message string, created_at timestamp NOT NULL, finished_at timestamp",
    "run_conference_years": "id bigint NOT NULL, run_id string NOT NULL, conference_year_id bigint NOT NULL",
    "run_events": "id bigint NOT NULL, run_id string NOT NULL, conference_year_id bigint, stage string NOT NULL, level string NOT NULL, message string NOT NULL, data_json string, created_at timestamp NOT NULL",
    "navigation_template_memory": "id bigint NOT NULL, domain string NOT NULL, template_key string NOT NULL, intent string, visits int NOT NULL, speaker_hits int NOT NULL, appearance_hits int NOT NULL, zero_yield_streak int NOT NULL, last_seen_at timestamp, updated_at timestamp NOT NULL",
}
BACKUP_TABLES = [t for t in SCHEMAS if t != "navigation_template_memory"]

# States a row can be in.
STATES = {
    ("conference_years", "status"): ["pending", "running", "complete", "blocked", "partial", "error"],
    ("scrape_runs", "status"): ["pending", "running", "complete", "partial", "error"],
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table with its declared columns, read with pushdown from Parquet."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")


def bad_states(df: DataFrame, name: str) -> DataFrame:
    """Rows with a state that the model doesn't know."""
    bad = F.lit(False)
    for (table, col), known in STATES.items():
        if table == name:
            bad = bad | ~F.col(col).isin(known)
    return df.where(bad)


def run_logs(spark: SparkSession, path: str) -> DataFrame:
    """Per-run JSON logs; malformed files give no rows and callers fall back to event counts."""
    schema = "run_id string, urls array<struct<url string, normalized_records int, nav_next_urls array<string>>>, years array<struct<conference_year_id bigint, conference_name string, year int, status string, linked int, duplicates int, notes string>>, _bad string"
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad is null and run_id is not null").drop("_bad")


def append_events(df: DataFrame, folder: str) -> None:
    """Adds rows to the events table; a task that fails leaves none of its rows."""
    df.select(*[F.col(f.name).cast(f.dataType) for f in empty(df.sparkSession, "run_events").schema.fields]).write.mode("append").parquet(f"{folder}/run_events")


def write_run_logs(df: DataFrame, path: str) -> None:
    """Rows with a run_id as JSON, one file set a run, visible only when the whole job is committed; a run written again is replaced."""
    df.withColumn("run", F.col("run_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").json(path)
