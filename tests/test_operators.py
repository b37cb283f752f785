"""De-duplication, windows, linkage, backup and streams."""

import pandas as pd
from pyspark.sql import functions as F

from tessella.operators import dedupe, frontier, linkage, navigation, resolve, windows
from tessella.sources import backup, tables
from tessella.streaming import events

from .conftest import DATA


def test_insert_if_absent_treats_nulls_as_equal(spark):
    have = spark.createDataFrame([(1, None), (2, "a")], "p long, s string")
    new = spark.createDataFrame([(1, None), (1, "b"), (1, "b"), (2, "a")], "p long, s string")
    assert [tuple(r) for r in dedupe.insert_absent(have, new, ["p", "s"]).collect()] == [(1, "b")]


def test_last_value_keeps_first_place(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 2, "y")], "k string, pos int, v string")
    assert sorted(map(tuple, dedupe.last_value(df, ["k"], "pos").collect())) == [("a", 1, "z"), ("b", 2, "y")]


def test_zero_novelty_stops_at_the_twelfth_page(spark):
    df = spark.range(15).select(F.lit(1).alias("r"), "id", F.lit(0).alias("n"))
    got = windows.zero_windows(df, F.col("n"), ["r"], "id").where("stops").agg(F.min("id")).first()[0]
    assert got == 11


def test_rate_window_drops_a_request_of_exactly_sixty_seconds(spark):
    df = spark.sql("select 'd' as k, timestamp'2024-01-01 00:00:00' as ts union all select 'd', timestamp'2024-01-01 00:01:00' union all select 'd', timestamp'2024-01-01 00:01:59.999999'")
    assert [r["in_minute"] for r in windows.minute_rate(df, ["k"], "ts").orderBy("ts").collect()] == [1, 1, 2]


PEOPLE = "id long, name_key string, designation string, affiliation string, location string, specialty string, profile_url string"


def test_merge_close(spark):
    rows = [(1, "anna bergman", "MD", "City Hospital", "Bonn", "eyes", "https://h.org/a"), (2, "anna bergmann", "MD", "City Hospital", "Bonn", "eyes", "https://h.org/b"), (3, "bruno kern", "MD", "City Hospital", "Bonn", "eyes", "https://h.org/c")]
    got = {(r["id"], r["target"]) for r in linkage.merge_close(spark.createDataFrame(rows, PEOPLE)).collect()}
    assert got == {(1, 1), (2, 1)}


def test_merge_skips_conflicts(spark):
    rows = [(1, "anna bergman", "MD", "City Hospital", "Bonn", None, None), (2, "anna bergmann", "MD", "Xyz Qqq", "Tokyo", None, None)]
    assert {(r["id"], r["target"]) for r in linkage.merge_close(spark.createDataFrame(rows, PEOPLE)).collect()} == {(1, 1), (2, 2)}


def test_filled_fields_can_enable_a_later_merge(spark):
    rows = [(1, "anna bergman", None, "City Hospital", "Bonn", None, None), (2, "anna bergmann", None, "City Hospital", "Bonn", "eyes", None), (3, "anna bergmanm", None, "City Hospital", None, "eyes", None)]
    got = {(r["id"], r["target"]) for r in linkage.merge_close(spark.createDataFrame(rows, PEOPLE)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}


def test_same_name_other_place_gets_a_variant():
    rows = pd.DataFrame([(1, "anna berg", None, "City Hospital", "Bonn", None, None), (2, "anna berg", None, "Xyz Qqq", "Tokyo", None, None), (3, "anna berg", None, None, None, None, None)], columns=[c.split()[0] for c in PEOPLE.split(", ")])
    keys = list(resolve.resolve_block(rows)["key"])
    assert keys[0] == keys[2] == "anna berg" and keys[1].startswith("anna berg::")


def test_heuristic_people(spark):
    df = spark.createDataFrame([(1, "welcome Anna Berg, M.D. and Carl Dorn, PhD today"), (2, "Join Dr. Eva Falk in the hall"), (3, "nobody here"), (4, "Anna Berg, MD and again Anna Berg, PhD"), (5, "Time Zone, MD and Dr. Eva Falk")], "id long, text string")
    got = sorted((r["id"], r["full_name"], r["designation"], r["confidence"]) for r in navigation.heuristic_people(df).collect())
    assert got == [(1, "Anna Berg", "MD", 0.62), (1, "Carl Dorn", "PhD", 0.62), (2, "Eva Falk", None, 0.45), (4, "Anna Berg", "PhD", 0.62), (5, "Eva Falk", None, 0.45)]


def test_crawl_is_best_first(spark):
    g = spark.createDataFrame([(0, 1, 0.2), (0, 2, 0.9), (2, 3, 0.5), (3, 4, 1.0)], "src long, dst long, priority double")
    assert [r["page_id"] for r in frontier.crawl(g, depth=2, pages=10).orderBy("visit").collect()] == [0, 2, 3, 1]


def _model(spark):
    t = "timestamp'2024-01-01'"
    rows = {
        "conferences": f"select 1L id, 'Eye Days' name, null canonical_name, null organizer_name, null event_series_name, null name_confidence, {t} created_at union all select 2L, 'Other', null, null, null, null, {t}",
        "conference_years": f"select 1L id, 1L conference_id, 2024 year, 'complete' status, null notes, {t} created_at union all select 2L, 2L, 2025, 'complete', null, {t}",
        "appearances": "select 1L id, 7L physician_id, 1L conference_year_id, null role, null session_title, null talk_brief_extracted, null talk_brief_generated, 0.5D confidence, null source_url union all select 2L, 7L, 2L, null, 's', null, null, 0.5D, null union all select 3L, 8L, 2L, null, 's', null, null, 0.5D, null",
    }
    out = {}
    for n in tables.SCHEMAS:
        want = tables.empty(spark, n).schema
        out[n] = spark.sql(rows[n]).select(*[F.col(f.name).cast(f.dataType) for f in want]) if n in rows else tables.empty(spark, n)
    return out


def test_backup_round_trip(spark, tmp_path):
    closed = backup.closure(_model(spark), ["eye"])
    assert {n: closed[n].count() for n in ("conferences", "conference_years", "appearances")} == {"conferences": 2, "conference_years": 2, "appearances": 2}
    backup.export(closed, str(tmp_path))
    again = backup.restore(spark, str(tmp_path))
    key = lambda t: sorted(map(tuple, backup.manifest(t).collect()))
    assert key(closed) == key(again)
    assert backup.next_ids(again)["appearances"] == 3
    assert tables.bad_states(again["conference_years"], "conference_years").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/sf0.001/events.parquet").select("event_id", "user_id", "event_type")
    half = e.count() // 2
    for k, part in enumerate((e.where(F.col("event_id") < half), e.where(F.col("event_id") >= half))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p{k}"))
    stream = events.read_events(spark, str(tmp_path / "in" / "*"), e.schema)
    q = events.template_memory_stream(stream).writeStream.outputMode("update").format("memory").queryName("mem").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    last = spark.table("mem").groupBy("user_id").agg(F.max(F.struct("visits", "speaker_hits", "appearance_hits", "streak")).alias("s")).select("user_id", "s.*")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, events.template_memory_batch(e).select("user_id", "visits", "speaker_hits", "appearance_hits", "streak").collect()))
    q = events.heartbeat(stream).writeStream.outputMode("complete").format("memory").queryName("beat").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("beat").collect())) == sorted(map(tuple, events.heartbeat_batch(e).collect()))


def test_fuzzy_pairs_and_groups_equal_brute_force(spark):
    import random

    from tessella.functions import names

    rng = random.Random(8)
    word = lambda: rng.choice("abc") + "".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 7)))
    people = []
    for i in range(120):
        n = [word() for _ in range(rng.randrange(1, 4))]
        people.append((2 * i, " ".join(n)))
        n[-1] = n[-1][: rng.randrange(1, len(n[-1]) + 1)] + rng.choice(["", "x", "en"])
        people.append((2 * i + 1, " ".join(rng.sample(n, len(n)) if i % 3 == 0 else n)))
    pairs = linkage.candidate_pairs(spark.createDataFrame(people, "id long, name_key string"))
    got = {(r["a"], r["b"]): round(r["score"], 6) for r in pairs.collect()}
    want = {(a, b): round(s, 6) for i, (a, x) in enumerate(people) for b, y in people[i + 1 :] if (s := names.identity(x, y)) >= 88}
    assert got == want and want
    low = {i: i for p in want for i in p}
    for _ in low:
        for a, b in want:
            low[a] = low[b] = min(low[a], low[b])
    assert {r["id"]: r["grp"] for r in linkage.groups(pairs).collect()} == low


def _copied_people(n: int) -> list[tuple]:
    """Records of few similar names and of profiles with gaps, so that order decides merges."""
    import random

    rng = random.Random(3)
    some = lambda *x: rng.choice([None, *x])
    last = ["berg", "bergx", "bergh", "berghof", "kern", "kerns", "kernst"]
    return [(i, f"{rng.choice(['anna', 'anne', 'bruno'])} {rng.choice(last)}" if i % 23 else "anna", some("MD"), some("City Hospital", "Quartz Institute", "City Hospitals"), some("Bonn", "Oslo"), some("eyes", "ears"), some("https://x.org/a", "https://y.org/b")) for i in range(n)]


_PERSON = "id long, name_key string, designation string, affiliation string, location string, specialty string, profile_url string"


def test_merge_of_copies_equals_the_plain_fold(spark):
    from tessella.functions import names

    rows = _copied_people(400)
    people = spark.createDataFrame(rows, _PERSON)
    linked = [(x[0], y[0]) for i, x in enumerate(rows) for y in rows[i + 1 :] if names.identity(x[1], y[1]) >= 88]
    state = {r[0]: dict(zip(linkage.FIELDS, r[2:], strict=True)) for r in rows}
    target = {r[0]: r[0] for r in rows}
    for a, b in linked:
        if target[a] == a and target[b] == b and not names.conflict(state[a], state[b]) and names.signals(state[a], state[b]) >= 2:
            target[b] = a
            state[a] = {k: v or state[b][k] for k, v in state[a].items()}
    got = {r["id"]: r["target"] for r in linkage.merge_close(people).collect()}
    assert got == {i: target[i] for p in linked for i in p}
    assert 50 < sum(a != b for a, b in got.items()) < 390 and any(state[r[0]] != dict(zip(linkage.FIELDS, r[2:], strict=True)) for r in rows)


def test_copies_are_compared_once(spark, monkeypatch):
    from tessella.functions import names

    rows = _copied_people(600)
    people = spark.createDataFrame(rows, _PERSON)
    low: dict = {}
    for r in rows:
        low.setdefault(r[1], r[0])
    want = {(low[r[1]], r[0], 100.0, True) for r in rows if low[r[1]] != r[0] and " " in r[1]}
    want |= {(min(a, b), max(a, b), round(s, 6), False) for x, a in low.items() for y, b in low.items() if a < b and (s := names.identity(x, y)) >= 88}
    got = [(r["a"], r["b"], round(r["score"], 6), r["copy"]) for r in linkage.class_pairs(people).collect()]
    assert len(got) == len(want) and set(got) == want and len(got) < 600 + 21 * 20
    # Expanded, they are all pairs of records.
    assert {(r["a"], r["b"]) for r in linkage.candidate_pairs(people).collect()} == {(x[0], y[0]) for i, x in enumerate(rows) for y in rows[i + 1 :] if names.identity(x[1], y[1]) >= 88}
    # The matcher gets every distinct name of both sides once.
    seen = []
    plain = linkage.prepared
    monkeypatch.setattr(linkage, "prepared", lambda df, *a: seen.append(df.count()) or plain(df, *a))
    odd, even = people.where("id % 2 = 1"), people.where("id % 2 = 0")
    found = {r["id"]: (r["match"], r["score"]) for r in resolve.best_match(odd, even).collect()}
    best = {}
    for x in rows[1::2]:
        scores = [(names.identity(x[1], y[1]), -y[0]) for y in rows[::2]]
        if max(scores)[0] >= 88:
            best[x[0]] = (-max(scores)[1], max(scores)[0])
    assert found == best and max(seen) <= 21


def test_overview_prefers_logs(spark):
    from tessella.operators import overview

    runs = spark.createDataFrame([("a", " Eyes ", "complete"), ("b", "Eyes", "partial"), ("c", None, "error"), ("d", "Ears", "running"), ("e", "Ears", "complete")], "run_id string, conference_name string, status string")
    events = spark.createDataFrame([(r, s, n) for r, s, n in (("a", "markdown_extract_end", 3), ("a", "fetch_route", 0), ("b", "markdown_extract_end", 2), ("b", "fetch_route", 0), ("b", "fetch_route", 0), ("c", "markdown_extract_end", 0), ("c", "fetch_route", 0), ("d", "markdown_extract_end", 9), ("e", "fetch_route", 0))], "run_id string, stage string, speakers int")
    logs = spark.createDataFrame([("a", [("u1", 2, [" x ", "y", ""]), ("u2", 0, None), ("u3", 1, ["x"])]), ("c", [("u1", 1, ["z"])])], "run_id string, urls array<struct<url string, normalized_records int, nav_next_urls array<string>>>")
    years = spark.createDataFrame([(1, "Eyes"), (2, "Ears"), (3, "Eyes")], "conference_year_id long, conference_name string")
    covered = spark.createDataFrame([("a", 1), ("b", 1), ("d", 2)], "run_id string, conference_year_id long")
    seen = spark.createDataFrame([(1, 7), (1, 7), (1, 8), (2, 7), (3, 9)], "conference_year_id long, physician_id long")
    tables = {"runs": runs, "run_years": covered, "years": years, "appearances": seen, "events": events, "logs": logs}
    got = {r["conference"]: r.asDict() for r in overview.by_conference(**tables).collect()}
    # The log of a gives 3 pages, 2 good, 2 links; b falls back to 2 routes and 1 good extraction; c has no speakers; e has no extraction.
    assert got["Eyes"] == {"conference": "Eyes", "speakers": 5, "pages": 5, "good": 3, "links": 2, "years": 1, "appearances": 3, "people": 2}
    assert got["Unknown"] == {"conference": "Unknown", "speakers": 0, "pages": 0, "good": 0, "links": 0, "years": 0, "appearances": 0, "people": 0}
    assert len(got) == 2
    assert overview.totals(**tables).first().asDict() == {"runs": 2, "conferences": 2, "speakers": 5, "pages": 5, "good": 3, "links": 2, "years": 1, "appearances": 3, "people": 2}
    nothing = {k: v.limit(0) for k, v in tables.items()}
    assert overview.by_conference(**nothing).count() == 0 and overview.totals(**nothing).first()["speakers"] == 0


def test_resolve_against_stored(spark):
    cols = "id long, name_key string, designation string, affiliation string, location string, specialty string, profile_url string"
    far = resolve.variant("anna berg", {"designation": None, "affiliation": "Quartz Institute", "location": "Oslo"})
    stored = spark.createDataFrame([(1, "anna berg", "MD", "City Hospital", "Bonn", None, None), (2, "bruno castellan", None, None, None, None, None), (3, f"dora falk::{far[-10:]}", None, "City Hospital", "Bonn", None, None)], cols)
    new = [(10, "anna berg", None, "City Hospital", None, None, None), (11, "anna berg", None, "Quartz Institute", "Oslo", None, None), (12, "anna berg", None, "Quartz Institute", "Oslo", None, None), (13, "bruno castelan", None, "X", "Y", None, None), (14, "carla dorn", None, None, None, None, None), (15, "dora falk", None, "City Hospital", "Bonn", None, None), (16, "dora falk", None, None, None, None, None)]
    got = dict(resolve.resolve(spark.createDataFrame(new, cols), stored).collect())
    # Same profile; another person of that name, twice; one letter off; new; a marked person with the same profile; nothing to compare.
    assert got == {10: "anna berg", 11: far, 12: far, 13: "bruno castellan", 14: "carla dorn", 15: f"dora falk::{far[-10:]}", 16: "dora falk"}
    assert resolve.resolve(spark.createDataFrame([], cols), stored).count() == 0
    assert dict(resolve.resolve(spark.createDataFrame(new[:1], cols), stored.limit(0)).collect()) == {10: "anna berg"}
    people = spark.createDataFrame([(1, "k1", "Anna Berg", ["Anna Berg, MD", " A. Berg ", ""]), (2, "k2", "Ann Berg", ["A Berg", "Annie Berg", "Old Name"])], "id long, key string, full_name string, aliases array<string>")
    known = spark.createDataFrame([("old name",)], "alias_key string")
    assert sorted(map(tuple, resolve.new_aliases(people, known).collect())) == [("k1", "A. Berg", "a berg"), ("k2", "Annie Berg", "annie berg")]
