"""Reserved seats, candidates, run states, targets, reachability and gates against plain versions of their rules."""

import random

from pyspark.sql import functions as F

from tessella.functions import fetch
from tessella.operators import navigation, runs


def seats(pool, k, rank=None):
    """Seats of one key, step by step: pool of (id, nth, score, core, depth, signal), chosen are the first k.

    rank: id -> rank by score, where it isn't nth.
    """
    chosen = [p for p in pool if p[1] <= k]
    others = sorted((p for p in pool if not p[3]), key=lambda p: (-(p[2] + 0.2 * p[4] + (1.2 if p[5] else 0)), rank[p[0]] if rank else p[1]))
    if len(chosen) <= max(3, k // 2) or not others:
        return [p[0] for p in chosen]
    wanted = others[: min(2, max(1, k // 6), len(others))]
    signal = next((p for p in others if p[5]), None)
    if signal and signal not in wanted:
        wanted = [*wanted[:-1], signal]
    for new in [p for p in wanted if p not in chosen]:
        tail = next((i for i in range(len(chosen) - 1, -1, -1) if chosen[i][3]), None)
        if tail is not None:
            chosen.pop(tail)
            chosen.append(new)
        elif len(chosen) < k:
            chosen.append(new)
    return [p[0] for p in chosen]


def test_reserved_seats_by_a_plain_version(spark):
    rng = random.Random(8)
    for k in (3, 6, 13):
        pools = {}
        for key in range(60):
            size = rng.randrange(1, 25)
            scores = sorted((rng.randrange(0, 60) / 10 for _ in range(size)), reverse=True)
            core = rng.choice((0.0, 0.3, 0.8, 1.0))
            pools[key] = [(1000 * key + i, i + 1, s, rng.random() < core, rng.randrange(0, 4), rng.random() < 0.2) for i, s in enumerate(scores)]
        rows = [(key, *p) for key, pool in pools.items() for p in pool]
        df = spark.createDataFrame(rows, "key int, id int, nth int, score double, own boolean, depth int, sig boolean").withColumn("place", F.when(F.col("nth") <= k, F.col("nth")))
        out = navigation.reserve_cross(df, "key", "nth", "score", F.col("own"), F.col("depth"), F.col("sig"), k).where("place IS NOT NULL").orderBy("key", "place").collect()
        got = {}
        for r in out:
            got.setdefault(r["key"], []).append(r["id"])
        assert got == {key: seats(pool, k) for key, pool in pools.items()}


def test_candidates_and_why(spark):
    rows = [
        (1, "https://x.org/a/speakers", "listing", "", None), (2, "https://x.org/a/speakers/", "listing", "", None), (3, "", "listing", "", None), (4, "https://x.org/a/x.pdf", "pdf", "speakers", None),
        (5, "https://x.org/a/b", "Non_Content ", "speakers", None), (6, "https://x.org/a/b2", None, "words", "/a"), (7, "https://x.org/a/b3", "", "the program", None), (8, "https://other.net/speakers", "listing", "", None), (9, "https://x.org/hotel", "listing", "", None),
    ]
    df = spark.createDataFrame([(*r, "k", "https://x.org/a", "https://x.org/a") for r in rows], "id int, url string, page_type string, reason string, branch_hint string, k string, seed string, page string")
    out = navigation.judge_candidates(df, "seed", "page", F.array(F.lit("eyes")), F.lit(False), ["k"], "id").collect()
    assert {r["id"]: r["why"] for r in out} == {1: "kept", 2: "repeated", 3: "empty", 4: "pdf", 5: "no_content", 6: "no_signal", 7: "kept", 8: "out_of_scope", 9: "out_of_scope"}


def test_states_of_years_and_runs(spark):
    r = spark.createDataFrame([(1, True, False, 0), (2, False, True, 0), (3, False, False, 2), (4, False, False, 0), (5, False, False, 0), (6, False, False, 0)], "run int, cancelled boolean, stalled boolean, blocked_pages int")
    y = spark.createDataFrame([(1, 3, 0), (5, 2, 0), (5, 1, 4), (6, 1, 0), (6, 0, 3)], "run int, linked int, duplicates int")
    got = {x["run"]: (x["years"], x["status"], (x["message"] or "")[:12]) for x in runs.run_status(y, r, "run").collect()}
    assert got == {1: (1, "partial", "Cancelled by"), 2: (0, "partial", "Run terminat"), 3: (0, "partial", "No attributa"), 4: (0, "error", "No attributa"), 5: (2, "complete", ""), 6: (2, "partial", "")}
    s = y.select(runs.year_status(F.col("linked"), F.col("duplicates")).alias("s")).select("s.*").collect()
    assert {x["notes"] for x in s} == {"Linked 3 physician appearance(s)", "Linked 2 physician appearance(s)", "Linked 1 physician appearance(s)", "Only duplicate appearance records found"}
    e = spark.createDataFrame([(1, i, k) for i, k in enumerate(["other", "fetch_route", "other", "cancelled", "complete"])], "run int, id int, stage string")
    assert [x["state"] for x in runs.transitions(e, "run", "id", F.col("stage")).orderBy("id").collect()] == ["pending", "running", "running", "cancelled", "cancelled"]


def test_targets_of_records(spark):
    kind = runs.KIND
    rows = [
        (1, [("A", 2024, 0.9)], [("B", 2023, 0.5)], [], "u", None), (2, [("A", 1980, 0.9)], [("B", 2023, 0.5), (" ", 2023, 0.5)], [], "u", " Run "), (3, None, None, [("A", 2020, None), ("B", 2021, None), ("C", 2021, None)], "https://x.org/2020/2021", None),
        (4, [], [], [("A", 2020, None)], "https://x.org/2019", None), (5, [], [], [("A", 2020, None), ("B", 2021, None)], "https://x.org/2019", None), (6, [], [], [], "2020", "Run"),
    ]
    df = spark.createDataFrame(rows, f"id int, own {kind}, found {kind}, known {kind}, url string, hint string")
    out = runs.targets(df, F.col("own"), F.col("found"), F.col("known"), F.col("url"), F.col("hint")).select("id", "rung", "conference", "year").orderBy("id").collect()
    assert [tuple(r) for r in out] == [(1, "explicit", "A", 2024), (2, "batch", "Run", 2023), (3, "url_year", "B", 2021), (4, "only_known", "A", 2020), (5, "unresolved", None, None), (6, "unresolved", None, None)]
    who = spark.createDataFrame([(1, "x", "A", None, "explicit"), (2, "x", "A", None, "batch"), (3, "y", "A", "s", "batch"), (4, "z", None, None, "unresolved")], "id int, p string, c string, s string, rung string")
    stored = spark.createDataFrame([("y", "A", "s")], "p string, c string, s string")
    assert {r["id"]: r["outcome"] for r in runs.links(who, stored, ["p", "c", "s"], "id").collect()} == {1: "linked", 2: "duplicate", 3: "duplicate", 4: "unresolved"}


def test_counters_take_increments_and_last_states(spark):
    e = spark.createDataFrame([("r", 1, '{"metrics": {"pages_visited": 2}, "gauges": {"frontier_size": 9}}'), ("r", 2, '{"counters": {"linked_appearances": 3, "blocked_pages": 1}, "gauges": {"frontier_size": 4}}'), ("r", 3, "bad"), ("r", 4, None), ("s", 5, '{"metrics": {"pages_visited": null}}')], "run string, id int, data string")
    b = spark.createDataFrame([("r", 1, 0), ("r", 0, 0), ("r", 0, 2)], "run string, new_people int, linked int")
    got = {(r["run"], r["metric"]): r["value"] for r in runs.metrics(e, "run", "id", "data", b).collect()}
    assert len(got) == 92 and {k: v for k, v in got.items() if v} == {("r", "pages_visited"): 2, ("r", "frontier_size"): 4, ("r", "appearances_linked"): 3, ("r", "high_yield_branches"): 2}


def test_reachable_pages_by_a_plain_walk(spark):
    rng = random.Random(9)
    links = {(p, f"u{rng.randrange(60)}") for p in range(80) for _ in range(rng.randrange(0, 3))}
    df = spark.createDataFrame(sorted(links), "page_id int, url string")
    want = {}
    for seed in (0, 1, 2):
        depth, level = {seed: 0}, {seed}
        for step in range(1, 5):
            urls = {u for p, u in links if p in level}
            level = {p for p, u in links if u in urls} - set(depth)
            depth |= dict.fromkeys(level, step)
        want |= {(seed, p): n for p, n in depth.items()}
    out = navigation.reachable(df, spark.createDataFrame([(s, s) for s in (0, 1, 2)], "seed int, page_id int")).collect()
    assert {(r["seed"], r["page_id"]): r["depth"] for r in out} == want


def test_reachable_pages_read_links_once(spark):
    read = spark.sparkContext.accumulator(0)

    def rows(part):
        for p in part:
            read.add(1)
            yield p, f"u{p}"
            yield p, f"u{p + 1}"

    links = spark.sparkContext.parallelize(range(40), 4).mapPartitions(rows).toDF("page_id int, url string")
    got = navigation.reachable(links, spark.createDataFrame([(0, 0), (1, 39)], "seed int, page_id int")).collect()
    assert {(r["seed"], r["page_id"], r["depth"]) for r in got} == {(0, n, n) for n in range(5)} | {(1, 39 - n, n) for n in range(5)}
    assert read.value == 40


def test_fetch_outcomes_and_gates(spark):
    page = "struct<kind: string, text: string, links: int, pdf_links: int>"
    good, thin = ("html", "x" * 400, 0, 0), ("html", "x", 0, 0)
    rows = [(1, "https://y.org/", True, good, None, good), (2, "https://x.org/", False, good, None, thin), (3, "https://x.org/", True, good, None, None), (4, "https://x.org/", True, thin, "e", good), (5, "https://x.org/", True, None, "timeout", good), (6, "https://x.org/", True, None, None, None)]
    df = spark.createDataFrame(rows, f"id int, seed string, enabled boolean, first {page}, error string, second {page}")
    o = df.select("id", fetch.crawl_outcome(F.col("seed"), F.lit("https://www.x.org/a"), F.col("enabled"), F.col("first"), F.col("error"), F.col("second")).alias("o")).select("id", "o.*").collect()
    assert {r["id"]: (r["status"], r["reason"], r["used_fallback"], len(r["text"])) for r in o} == {1: ("error", "out_of_domain", False, 0), 2: ("fetched", "crawl4ai_disabled", True, 1), 3: ("fetched", None, False, 400), 4: ("fetched", "crawl4ai_thin_content", True, 400), 5: ("fetched", "timeout", True, 400), 6: ("error", "crawl4ai_failed", True, 0)}
    one = lambda c: spark.range(1).select(c.alias("c")).first()["c"]
    gate = lambda **k: one(fetch.explores_interactions(**{a: (v if a in ("deepest", "least", "window") else F.lit(v)) for a, v in {"enabled": True, "depth": 1, "deepest": 4, "kind": "html", "links": 9, "blocks": 5, "streak": 0, "least": 6, "window": 8, **k}.items()}))
    assert [gate(), gate(links=5), gate(blocks=0), gate(streak=4), gate(links=0, depth=4), gate(links=0, kind="pdf"), gate(links=0, enabled=False)] == [False, True, True, True, False, False, False]
    assert one(fetch.model_choice(F.lit("triage"), ["triage"], " r ", "c")) == "r" and one(fetch.model_choice(F.lit("triage"), ["triage"], "", "c")) == "c" and one(fetch.model_choice(F.lit("default"), ["default"], "r", "c")) == "c"
    assert one(fetch.work_key("v", F.array(F.lit("b"), F.lit("a")))) == one(fetch.work_key("v", F.array(F.lit("a"), F.lit("b"))))
    assert one(fetch.age_days(F.lit("2024-01-01 00:00:00"), F.lit("2024-01-02 12:00:00"))) == 1.5 and one(fetch.age_days(F.lit("2024-01-02 00:00:00"), F.lit("2024-01-01 00:00:00"))) == 0.0
