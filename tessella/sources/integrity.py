"""Loading tables in the order of their foreign keys: orphans, sequences, dense ids, and schema versions of data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import SCHEMAS, empty

Tables = dict[str, DataFrame]
Keys = dict[str, dict[str, str]]

#: table -> column -> the table whose id it holds.
FOREIGN_KEYS: Keys = {
    "conferences": {},
    "conference_years": {"conference_id": "conferences"},
    "sources": {"conference_year_id": "conference_years"},
    "extractions": {"source_id": "sources"},
    "physicians": {},
    "physician_aliases": {"physician_id": "physicians"},
    "appearances": {"physician_id": "physicians", "conference_year_id": "conference_years"},
    "scrape_runs": {"conference_id": "conferences"},
    "run_conference_years": {"run_id": "scrape_runs", "conference_year_id": "conference_years"},
    "run_events": {"run_id": "scrape_runs", "conference_year_id": "conference_years"},
}


def load_order(keys: Keys) -> list[str]:
    """Tables so that each follows those it refers to; ties by name."""
    done: list[str] = []
    while len(done) < len(keys):
        ready = sorted(t for t, fks in keys.items() if t not in done and set(fks.values()) <= {*done, t})
        if not ready:
            raise ValueError(f"foreign keys go round in {sorted(set(keys) - set(done))}")
        done += ready
    return done


def ordered(tables: Tables, keys: Keys = FOREIGN_KEYS) -> Tables:
    """Tables in load order without orphans: rows whose keys are null or held by a loaded row.

    A row that goes takes those that refer to it with it.
    """
    out: Tables = {}
    for name in load_order(keys):
        df = tables[name]
        for column, parent in keys[name].items():
            ids = out[parent].select(F.col("id").alias("_id"))
            held = df.join(ids, F.col(column) == F.col("_id"), "left_semi")
            df = held.unionByName(df.where(F.col(column).isNull()))
        out[name] = df
    return out


def orphans(tables: Tables, keys: Keys = FOREIGN_KEYS) -> DataFrame:
    """(table_name, rows, loaded, orphans) of every table."""
    kept = ordered(tables, keys)

    def counted(name: str) -> DataFrame:
        given = tables[name].agg(F.count("*").alias("rows"))
        return given.crossJoin(kept[name].agg(F.count("*").alias("loaded"))).select(F.lit(name).alias("table_name"), "rows", "loaded", (F.col("rows") - F.col("loaded")).alias("orphans"))

    return reduce(DataFrame.unionByName, [counted(n) for n in kept])


def sequences(tables: Tables) -> DataFrame:
    """(table_name, last_value, is_called, next_id) of every table with a numeric id, as a sequence stands after a load."""
    def one(name: str, df: DataFrame) -> DataFrame:
        s = df.agg(F.coalesce(F.max("id"), F.lit(1)).cast("long").alias("last_value"), (F.count("*") > 0).alias("is_called"))
        return s.select(F.lit(name).alias("table_name"), "last_value", "is_called", F.when(F.col("is_called"), F.col("last_value") + 1).otherwise(F.col("last_value")).alias("next_id"))

    return reduce(DataFrame.unionByName, [one(n, df) for n, df in tables.items() if df.schema["id"].dataType.simpleString() in ("int", "bigint")])


def dense_ids(df: DataFrame, width: int = 4096) -> DataFrame:
    """(id, new): ids numbered from 1 in their order, without one task for all rows.

    Rows are numbered inside ranges of `width` ids and shifted by what the ranges
    before them hold; only the ranges' counts are added up in one task.
    """
    at = df.select("id", F.floor(F.col("id") / width).alias("_range"))
    counts = at.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select(F.col("_range").alias("_r"), (F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy("id"))
    return at.withColumn("_nth", nth).join(before, F.col("_range") == F.col("_r")).select("id", (F.col("_before") + F.col("_nth")).alias("new"))


def renumbered(tables: Tables, keys: Keys = FOREIGN_KEYS) -> Tables:
    """Loaded tables with ids from 1 without gaps, and all references to them; text ids stay."""
    kept = ordered(tables, keys)
    numeric = {n for n, df in kept.items() if df.schema["id"].dataType.simpleString() in ("int", "bigint")}
    maps = {n: dense_ids(kept[n]) for n in numeric}
    out: Tables = {}
    for name, df in kept.items():
        columns = df.columns
        for column, parent in [("id", name), *keys[name].items()]:
            if parent in numeric:
                m = maps[parent].select(F.col("id").alias("_old"), F.col("new").alias("_new"))
                df = df.join(m, F.col(column) == F.col("_old"), "left").withColumn(column, F.col("_new")).drop("_old", "_new")
        out[name] = df.select(*columns)
    return out


# Schema versions: what each one adds to the one before.  A value is what rows that are there get.
ADD, CREATE, SET = "add", "create", "set"
STEPS: list[list[tuple[str, str, str, str | None]]] = [
    [],
    [(ADD, "scrape_runs", "home_url", ""), (CREATE, "run_conference_years", "", None)],
    [(ADD, "conferences", c, None) for c in ("organizer_name", "event_series_name", "name_confidence")],
    [(ADD, "scrape_runs", "conference_name", None)],
    [(ADD, "physicians", c, None) for c in ("primary_specialty", "primary_education", "primary_profile_url")],
    [(ADD, "physicians", c, None) for c in ("photo_url", "photo_source_url", "bio_short", "bio_source_url", "enrichment_confidence", "enrichment_updated_at")],
    [(CREATE, "navigation_template_memory", "", None)],
    [(SET, "physicians", "photo_url", None), (SET, "physicians", "photo_source_url", None)],
]
LATEST = len(STEPS)


def _types(table: str) -> dict[str, str]:
    return {c.split()[0]: c.split()[1] for c in SCHEMAS[table].split(", ")}


def columns_at(version: int) -> dict[str, list[str]]:
    """Tables and their columns at a version."""
    later = [change for step in STEPS[version:] for change in step]
    made = {t for kind, t, _, _ in later if kind == CREATE}
    added = {(t, c) for kind, t, c, _ in later if kind == ADD}
    return {t: [c for c in _types(t) if (t, c) not in added] for t in SCHEMAS if t not in made}


def upgrade(tables: Tables, version: int, to: int = LATEST) -> Tables:
    """Tables of a version as tables of a later one; every step is a projection, so all of them are one."""
    if not 1 <= version <= to <= LATEST:
        raise ValueError(f"versions are 1 to {LATEST}, upwards")
    spark = next(iter(tables.values())).sparkSession
    out = dict(tables)
    for step in STEPS[version:to]:
        for kind, table, column, value in step:
            if kind == CREATE:
                out[table] = empty(spark, table)
            else:
                out[table] = out[table].withColumn(column, F.lit(value).cast(_types(table)[column]))
    names = columns_at(to)
    return {t: df.select(*names[t]) for t, df in out.items()}


def wrong_columns(tables: Tables, version: int = LATEST) -> list[str]:
    """What keeps tables from being of a version: missing tables and columns, and columns of another type."""
    out = []
    for table, names in columns_at(version).items():
        has = dict(tables[table].dtypes) if table in tables else None
        out += [table] if has is None else [f"{table}.{c}" for c in names if has.get(c) != _types(table)[c]]
    return out
