"""Golden cases of page rules, upserts and run control."""

from pyspark.sql import functions as F

from tessella.functions import pages as P
from tessella.operators import dedupe, windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_thin(spark):
    df = spark.createDataFrame([("pdf", "x" * 39, 5), ("pdf", "x" * 40, 0), ("html", " " * 400, 0), ("html", "x", 1), ("html", "x" * 300, 0), (None, None, 0)], "t string, s string, n int")
    assert [r.x for r in df.select(P.is_thin(F.col("t"), F.col("s"), F.col("n"), F.lit(0)).alias("x")).collect()] == [True, False, True, False, False, True]


def test_better_fetch(spark):
    df = spark.createDataFrame([("html", "a", "bb"), ("html", "aa", "bb"), ("html", "a" * 1200, "b" * 2000), ("pdf", "a", "bb"), ("html", None, "b"), ("html", "a", None)], "t string, a string, b string")
    assert [r.x for r in df.select(P.better_fetch(F.col("t"), F.col("a"), F.col("b")).alias("x")).collect()] == ["rendered", "static", "static", "static", "rendered", "static"]


def test_sitemaps(spark):
    xml = "<urlset><url><loc>\n https://a.org/1 </loc></url><url><loc> </loc></url><sitemap><loc>https://a.org/s.xml</loc></sitemap></urlset>"
    assert one(spark, P.sitemap_locations(F.lit(xml))) == ["https://a.org/1"]
    robots = "User-agent: *\r\nSitemap: https://a.org/s1.xml\r\n sitemap:https://a.org/s2.xml \nDisallow: /\nSitemap:\n"
    assert one(spark, P.robots_sitemaps(F.lit("https://a.org"), F.lit(robots))) == ["https://a.org/sitemap.xml", "https://a.org/s1.xml", "https://a.org/s2.xml"]
    assert one(spark, P.robots_sitemaps(F.lit("https://a.org"), F.lit(None).cast("string"))) == ["https://a.org/sitemap.xml"]


def test_titles_and_names(spark):
    assert one(spark, P.title_parts(F.lit(" Eye  Week 2024 | Program – Day 1: Cornea — "))) == ["Eye Week 2024", "Program", "Day 1", "Cornea"]
    assert one(spark, P.title_parts(F.lit(None).cast("string"))) == []
    assert [one(spark, P.file_slug(F.lit(x))) for x in (" Eye Week/2024! ", "Ärzte_1", "--", "")] == ["eye-week-2024", "ärzte_1", "backup", "backup"]
    assert [tuple(one(spark, P.first_last(F.lit(x)))) for x in (" Rupa  N. Patel ", "Rupa", "")] == [("Rupa", "Patel"), (None, None), (None, None)]
    assert one(spark, P.link_text(F.lit("  "), F.lit("/a/Program-2024/"))) == "Program-2024"


def test_newest_years(spark):
    got = [one(spark, P.newest_years(F.array(*[F.lit(y) for y in ys]), 2025)) for ys in ([2019, 2024, 2027, 2026, 2025], [2001, 1999, 1989, 2010, 2005], [2028])]
    assert got == [[2025, 2026, 2027], [2001, 2005, 2010], [2028]]


def test_year_hints(spark):
    t = lambda n, y: F.struct(F.lit(n).alias("name"), F.lit(y).alias("year"))
    got = one(spark, P.year_hints(F.array(t("Eye Week", 2024), t("EYE WEEK", 2024), t(" ", 2024), t("Eye Week", 1980)), F.lit(" eye  week "), F.array(F.lit(2025), F.lit(2024), F.lit(2101))))
    assert [tuple(x) for x in got] == [("Eye Week", 2024), ("eye week", 2025)]
    assert len(one(spark, P.year_hints(F.slice(F.array(t("x", 2000)), 1, 0), F.lit("a"), F.sequence(F.lit(2000), F.lit(2020))))) == 8


def test_triage_and_types(spark):
    got = [one(spark, P.triage(F.lit(u), F.lit(t), F.lit(None)))[0] for u, t in (("https://a/x.PDF", ""), ("https://a", "Faculty agenda"), ("https://a", "Agenda"), ("https://whova.com", None), ("https://a", ""))]
    assert got == ["pdf_program", "official_speakers", "official_program", "platform", "unknown"]
    assert [one(spark, P.seed_page_type(F.lit(k), F.lit(t), F.lit(None))) for k, t in (("pdf", "Our speakers"), ("html", "Sessions"), ("pdf", "x"), (None, None))] == ["speakers", "program", "pdf", "homepage"]


def test_upsert_and_ordered_union(spark):
    s = spark.createDataFrame([("a", 1, 0.5, None), ("b", 2, None, "old")], "k string, o int, c double, t string")
    i = spark.createDataFrame([("a", 0, 0.4, "second"), ("a", 1, 0.9, "third"), ("b", 1, 0.1, "new"), ("c", 1, None, None)], s.schema)
    got = {r.k: tuple(r)[1:] for r in dedupe.upsert(s, i, "k", "o", ["c"], ["t"]).collect()}
    assert got == {"a": (0.9, "second", True), "b": (0.1, "old", True), "c": (None, None, False)}
    got = {r.k: (r.source, r.o) for r in dedupe.ordered_union([s.select("k", "o"), i.select("k", "o")], ["k"], "o").collect()}
    assert got == {"a": (0, 1), "b": (0, 2), "c": (1, 1)}


def test_run_control(spark):
    a = spark.createDataFrame([(i, n, d) for i, (n, d) in enumerate([(0, 10), (0, 180), (0, 0), (0, 0), (1, 0), (0, 0), (0, 0), (0, 0), (5, 500)])], "i int, n int, d int").withColumn("k", F.lit(1))
    got = windows.interactions(a, F.col("n"), F.col("d"), ["k"], "i").orderBy("i").collect()
    assert [(r.novel, r.streak) for r in got] == [(False, 1), (True, 0), (False, 1), (False, 2), (True, 0), (False, 1), (False, 2), (False, 3)]
    t = spark.createDataFrame([(0, 0), (1, 240), (2, 481), (3, 500), (4, 900)], "i int, s int").select(F.lit(1).alias("k"), "i", F.timestamp_seconds("s").alias("ts"))
    got = windows.watchdog(t, ["k"], "ts", "i").orderBy("i").collect()
    assert [(r.stalled, r.stalls, r.terminal) for r in got] == [(False, 0, False), (False, 0, False), (True, 1, False), (False, 1, False), (True, 2, True)]
    v = spark.createDataFrame([(1, 0, True, 0, "x"), (1, 1, True, 0, ""), (2, 0, True, 1, None), (3, 0, None, 0, "y")], "k int, o int, v boolean, n int, r string")
    got = {r.k: (r.stop, r.reason) for r in windows.unanimous(v, ["k"], F.col("v"), F.col("n"), F.col("r"), "o").collect()}
    assert got == {1: (True, "x"), 2: (False, None), 3: (False, "y")}


def test_writers(spark, tmp_path):
    from tessella.sources import tables

    folder = f"file://{tmp_path}"
    rows = tables.empty(spark, "run_events").unionByName(spark.range(3).select(F.col("id").alias("id")), allowMissingColumns=True)
    tables.append_events(rows, folder)
    tables.append_events(rows, folder)
    assert tables.load(spark, folder, "run_events").count() == 6
    logs = spark.createDataFrame([("r1", [("https://a", 2, ["https://b"])]), ("r2", [])], "run_id string, urls array<struct<url string, normalized_records int, nav_next_urls array<string>>>")
    for _ in range(2):
        tables.write_run_logs(logs.where("run_id = 'r1'"), f"{folder}/logs")
        tables.write_run_logs(logs.where("run_id = 'r2'"), f"{folder}/logs")
    assert sorted(r.run_id for r in tables.run_logs(spark, f"{folder}/logs/*").collect()) == ["r1", "r2"]


def test_attribution(spark):
    from tessella.functions import attribution as A

    years = lambda *y: F.array(*[F.lit(v) for v in y]) if y else F.array().cast("array<int>")
    known = F.array(F.struct(F.lit(" Eye Week ").alias("name"), F.lit(2019).alias("year")), F.struct(F.lit("").alias("name"), F.lit(2101).alias("year")))
    cases = [((2020, 2022), (2030,), (), ()), ((), (2018, 2021), (), ()), ((), (), (2017,), (2001,)), ((), (), (2016, 2017), (2001, 2005)), ((), (), (), ())]
    got = [one(spark, A.relaxed_year(*[years(*x) for x in c], known)) for c in cases]
    assert got == [2022, 2021, 2017, 2005, 2019]
    none = F.lit(None).cast("string")
    target = lambda run, name, k, y, c: one(spark, A.relaxed_target(run, name, k, F.lit(y), F.lit(c)))
    assert tuple(target(F.lit(" "), F.lit("Main"), known, 2020, 0.95)) == ("Main", 2020, 0.8, "relaxed_context_fallback")
    assert tuple(target(none, none, known, 2020, 0.1)) == ("Eye Week", 2020, 0.35, "relaxed_context_fallback")
    assert target(F.lit("Run"), none, known, 2020, 0.0)[2] == 0.55
    assert target(none, none, F.slice(known, 1, 0), 2020, 0.5) is None and target(F.lit("Run"), none, known, 2101, 0.5) is None
    t = lambda n, y: F.array(F.struct(F.lit(n).alias("name"), F.lit(y).alias("year"), F.lit(0.5).alias("confidence"), F.lit("r").alias("reason")))
    pick = lambda a, b, c: [x.name for x in one(spark, A.resolve_targets(a, b, F.get(c, F.lit(0))))]
    assert [pick(t("own", 2020), t("found", 2020), t("relaxed", 2020)), pick(t("own", 1900), t("found", 2020), t("relaxed", 2020)), pick(t("own", 1900), F.slice(t("", 1), 1, 0), t("relaxed", 2020))] == [["own"], ["found"], ["relaxed"]]


def test_gates(spark):
    noise = [one(spark, P.is_nav_noise(F.lit(x))) for x in ("Register now", "Register now: Rupa Patel, MD", "Register now 9:30 am", "Cornea talk", None)]
    assert noise == [True, False, False, False, False]
    d = lambda on, did, intent, n, m, blob: tuple(one(spark, P.expand_decision(F.lit(on), F.lit(did), F.lit(intent), F.lit(n), F.lit(m), F.lit(blob))))
    assert d(False, True, "listing", 0, 0, "accordion") == (False, "disabled")
    assert d(True, False, "pdf", 0, 0, "accordion") == (False, "intent_pdf_not_targeted")
    assert d(True, False, "listing", 0, 0, None) == (False, "no_dynamic_signal")
    assert d(True, False, "listing", 3, 0, "Load More") == (False, "baseline_yield_sufficient")
    assert d(True, False, "listing", 2, 0, "x" * 90000 + "Load More") == (True, "low_yield_dynamic_page")
    link = lambda cand, role, ses, conf, text: one(spark, P.is_linkable(F.lit(cand), F.lit(role), F.lit(ses), F.lit(conf), F.lit(text)))
    assert [link(True, None, None, None, None), link(None, "Co-Chair", None, None, None), link(None, None, "Talk", 0.6, None), link(None, None, "Talk", 0.5, None), link(None, None, None, None, "a Surgeon")] == [True, True, True, False, True]


def test_filter_links(spark):
    from tessella.operators import navigation

    s = "https://a.org/meet"
    rows = spark.createDataFrame([(0, " ", "x"), (1, "https://a.org/meet/speakers", "Speakers"), (2, "https://a.org/meet/speakers/?utm_source=x", "Speakers"), (3, "https://a.org/p.pdf", "Program"), (4, "https://b.org/speakers", "Speakers"), (5, "https://a.org/hotel", "Hotel"), (6, None, None)], "pos int, url string, text string").withColumn("k", F.lit(1)).withColumn("seed", F.lit(s))
    got = navigation.filter_links(rows, "seed", "seed", F.array(F.lit("cornea")), F.lit(False), ["k"], "pos").orderBy("pos").collect()
    assert [r.why for r in got] == ["empty", "kept", "repeated", "pdf", "out_of_scope", "out_of_scope", "empty"]
