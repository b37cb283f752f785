"""Dashboards and read queries over the relational model, on the star tables that stand for it.

nation: conferences; (nation, order year): conference years; customer: people;
orders: appearances (session: priority, role: status); events: run events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import dedupe, overview


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def appearances(spark: SparkSession, d: str) -> DataFrame:
    """Appearances with conference and year; nation is a dimension of fixed size, joins on it broadcast by its statistics."""
    o, c, n = read(spark, d, "orders"), read(spark, d, "customer"), read(spark, d, "nation")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).withColumn("year", F.year("o_orderdate"))


def overview_by_grain(spark: SparkSession, d: str) -> DataFrame:
    a = appearances(spark, d)
    return a.groupingSets([["n_name", "year"], ["n_name"], []], "n_name", "year").agg(F.count("*").alias("appearances"), F.count_distinct("o_custkey").alias("people"), F.grouping_id().cast("int").alias("grain"))


def overview_totals(spark: SparkSession, d: str) -> DataFrame:
    a = appearances(spark, d)
    return a.agg(F.count_distinct("n_name").alias("conferences"), F.count_distinct(F.struct("n_name", "year")).alias("years"), F.count_distinct("o_custkey").alias("people"), F.count("*").alias("appearances"), F.sum((F.col("o_orderstatus") == "F").cast("long")).alias("good"))


def speaker_sums_json(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.groupBy("user_id").agg(F.sum(scores.safe_int(F.col("props"), "$.k")).alias("speakers"), F.count("*").alias("events"))


def event_stage_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


def link_events_by_year(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").where(F.col("event_type").isin("click", "purchase"))
    return e.groupBy("user_id").agg(F.count("*").alias("linked"))


def filtered_event_counts(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.agg(F.count_if(F.col("event_type") == "view").alias("routes"), F.count_if((F.col("event_type") == "click") & (scores.safe_int(F.col("props"), "$.k") > 0)).alias("good_pages"))


def conference_totals(spark: SparkSession, d: str) -> DataFrame:
    return appearances(spark, d).groupBy("n_name").agg(F.count_distinct("o_custkey").alias("people"), F.count("*").alias("appearances"))


def year_group_cards(spark: SparkSession, d: str) -> DataFrame:
    return appearances(spark, d).groupBy("n_name", "year", "o_custkey").agg(F.count("*").alias("appearances"), F.count_distinct("o_orderpriority").alias("sessions"))


def person_cards(spark: SparkSession, d: str) -> DataFrame:
    c, o = read(spark, d, "customer"), read(spark, d, "orders")
    counts = o.groupBy("o_custkey").agg(F.count_distinct(F.year("o_orderdate")).alias("conferences"), F.count("*").alias("appearances"))
    return c.join(counts, c.c_custkey == counts.o_custkey, "left").select("c_custkey", "c_name", F.coalesce("conferences", F.lit(0)).alias("conferences"), F.coalesce("appearances", F.lit(0)).alias("appearances"), F.lit(None).cast("string").alias("photo_url"))


def nested_people(spark: SparkSession, d: str) -> DataFrame:
    """People with their appearances as an ordered list; people without any keep an empty one."""
    c, o = read(spark, d, "customer"), read(spark, d, "orders")
    lists = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus"))).alias("items"))
    return c.join(lists, c.c_custkey == lists.o_custkey, "left").select("c_custkey", "c_name", F.coalesce("items", F.array().cast(lists.schema["items"].dataType)).alias("items"))


def nested_people_list(spark: SparkSession, d: str) -> DataFrame:
    items = F.array_join(F.transform("items", lambda i: i["o_orderkey"].cast("string")), ",")
    return nested_people(spark, d).select("c_custkey", "c_name", F.size("items").alias("n_items"), items.alias("item_keys"))


def people_filtered(spark: SparkSession, d: str, q: str = "mer#0000001") -> DataFrame:
    """Case-insensitive contains (wildcards in the query stay wildcards), people kept by appearances of one year."""
    c, o = read(spark, d, "customer"), read(spark, d, "orders").where(F.year("o_orderdate") == 1997)
    return c.where(F.lower("c_name").like(f"%{q.lower()}%")).join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


def token_or_search(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    hit = F.lit(False)
    for col in ("p_name", "p_brand", "p_type"):
        for token in ("ring", "brand#2", "promo"):
            hit = hit | F.lower(F.coalesce(col, F.lit(""))).like(f"%{token}%")
    return p.where(hit & ~F.col("p_name").startswith("small")).select("p_partkey", "p_name")


def run_list_newest(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "P"))
    return o.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select("o_orderkey", "o_orderstatus")


def event_cursor_page(spark: SparkSession, d: str, cursor: int = 500, limit: int = 200) -> DataFrame:
    return read(spark, d, "events").where(F.col("event_id") > cursor).orderBy("event_id").limit(limit).select("event_id", "event_type", "user_id")


def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Of each run the newest heartbeat, or its newest completion where it has none."""
    e = read(spark, d, "events")
    beat = F.max_by("props", F.when(F.col("event_type") == "view", F.col("event_id")))
    done = F.max_by("props", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return e.groupBy("user_id").agg(beat.alias("b"), F.max(F.when(F.col("event_type") == "view", F.col("event_id"))).alias("bi"), done.alias("d"), F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("di")).select("user_id", F.coalesce("bi", "di").alias("event_id"), scores.safe_int(F.when(F.col("bi").isNotNull(), F.col("b")).otherwise(F.col("d")), "$.k").alias("k"))


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.groupBy("user_id").agg(F.count_distinct(F.lower("event_type")).alias("stages"), F.greatest(F.max(scores.safe_int(F.col("props"), "$.k")), F.count_if(F.col("event_type") == "click").cast("int")).alias("linked"))


def run_status(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("linked"), F.count_if(F.col("event_type") == "error").alias("dup"))
    status = F.when(F.col("linked") > 150, "complete").when(F.col("dup") > 150, "partial_duplicates").otherwise("partial")
    return e.select("user_id", "linked", "dup", status.alias("status"))


def latest_artifact(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return docs.groupBy("source").agg(F.max("doc_id").alias("doc_id"), F.max_by("n_chars", "doc_id").alias("n_chars"))


def backfill_join(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    return docs.join(labels, (docs.doc_id == labels.doc_id) & (labels.quality == 1)).groupBy("source", "lang").agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars"))


def backup_closure(spark: SparkSession, d: str) -> DataFrame:
    """From the conferences of a region: people there, all their appearances, and all conferences these touch."""
    n, r, c, o, l, s = (read(spark, d, t) for t in ("nation", "region", "customer", "orders", "lineitem", "supplier"))
    seed = n.join(r.where(F.lower("r_name").like("%asia%")), n.n_regionkey == r.r_regionkey, "left_semi")
    people = c.join(seed, c.c_nationkey == seed.n_nationkey, "left_semi")
    apps = o.join(people, o.o_custkey == people.c_custkey, "left_semi")
    items = l.join(apps, l.l_orderkey == apps.o_orderkey, "left_semi")
    touched = s.join(items, s.s_suppkey == items.l_suppkey, "left_semi").select(F.col("s_nationkey").alias("n_nationkey")).union(seed.select("n_nationkey")).distinct()
    rows = [("people", people), ("appearances", apps), ("items", items), ("conferences", touched)]
    out = None
    for name, df in rows:
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.union(one)
    return out


def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_custkey", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("session"), F.year("o_orderdate").alias("year"))
    return dedupe.insert_absent(o.where("year < 1996"), o.where("year >= 1996").select("o_custkey", "session", "year").drop("year"), ["o_custkey", "session"])


def completion_anti_join(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_custkey", F.lower("o_orderpriority").alias("session"), "o_orderstatus")
    return o.where("o_orderstatus = 'P'").join(o.where("o_orderstatus = 'F'"), ["o_custkey", "session"], "left_anti").groupBy("session").agg(F.count("*").alias("missing"))


def artifacts(rows: DataFrame, key: str, kinds: dict[str, Column]) -> DataFrame:
    """(key, artifact, data): one row for each kind that isn't empty; of equal keys, one."""
    each = rows.select(key, F.explode(F.array(*[F.struct(F.lit(k).alias("artifact"), v.alias("data")) for k, v in kinds.items()])).alias("a"))
    return each.select(key, "a.artifact", "a.data").where("data != ''").dropDuplicates([key, "artifact"])


def artifact_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return artifacts(read(spark, d, "documents"), "doc_id", {"clean_text": F.col("text"), "lang": F.col("lang"), "source": F.col("source")})


def kpi_sort(spark: SparkSession, d: str) -> DataFrame:
    a = conference_totals(spark, d)
    w = Window.orderBy(F.desc("people"), F.desc("appearances"), F.lower("n_name"))  # one row a conference
    return a.withColumn("place", F.row_number().over(w))


def run_model(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Runs, run years, years, appearances, events and logs: users are runs, (nation, year) conference years.

    Every fifth run is unfinished, every other one has a log; nation is a dimension of fixed size.
    """
    e, n, k = read(spark, d, "events"), read(spark, d, "nation"), scores.safe_int(F.col("props"), "$.k")
    users, run = e.select("user_id").distinct(), F.col("user_id").cast("string").alias("run_id")
    runs = users.join(n, F.col("user_id") % 25 == F.col("n_nationkey")).select(run, F.when(F.col("user_id") % 11 != 0, F.concat(F.lit(" "), "n_name")).alias("conference_name"), F.when(F.col("user_id") % 5 == 0, "running").otherwise("complete").alias("status"))
    year_id = lambda nation, year: (F.col(nation) * 10000 + year).cast("long").alias("conference_year_id")
    run_years = users.withColumn("n", F.col("user_id") % 25).select(run, year_id("n", 1992 + F.col("user_id") % 7))
    a = appearances(spark, d)
    years = a.select(year_id("c_nationkey", F.col("year")), F.col("n_name").alias("conference_name")).distinct()
    stage = F.when(F.col("event_type") == "view", "fetch_route").when(F.col("event_type") == "click", "markdown_extract_end").otherwise("other")
    events = e.select(run, stage.alias("stage"), k.alias("speakers"))
    page = F.struct(k.alias("normalized_records"), F.array(F.concat(F.lit(" u"), (F.col("event_id") % 997).cast("string")), F.lit(" ")).alias("nav_next_urls"))
    logs = e.where("user_id % 2 = 0 and event_type = 'signup'").groupBy(run).agg(F.collect_list(page).alias("urls"))
    return {"runs": runs, "run_years": run_years, "years": years, "appearances": a.select(year_id("c_nationkey", F.col("year")), F.col("o_custkey").alias("physician_id")), "events": events, "logs": logs}


def overview_of_runs(spark: SparkSession, d: str) -> DataFrame:
    return overview.by_conference(**run_model(spark, d))


def overview_run_totals(spark: SparkSession, d: str) -> DataFrame:
    return overview.totals(**run_model(spark, d))
