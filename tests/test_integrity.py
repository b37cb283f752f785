"""Loads by foreign keys, sequences, dense ids, schema versions."""

import pytest

from tessella.sources import backup, integrity, tables


def model(spark, **rows):
    out = {t: tables.empty(spark, t) for t in tables.SCHEMAS}
    for t, values in rows.items():
        names = [c.split()[0] for c in tables.SCHEMAS[t].split(", ")]
        types = {c.split()[0]: c.split()[1] for c in tables.SCHEMAS[t].split(", ")}
        out[t] = spark.createDataFrame([tuple(v.get(n) for n in names) for v in values], ", ".join(f"{n} {types[n]}" for n in names))
    return out


def ids(df):
    return sorted(r["id"] for r in df.collect())


def small(spark):
    return model(
        spark,
        conferences=[{"id": 10, "name": "A"}],
        conference_years=[{"id": 5, "conference_id": 10, "year": 2024}, {"id": 9, "conference_id": 11, "year": 2024}],
        physicians=[{"id": 100, "full_name": "X"}, {"id": 7, "full_name": "Y"}],
        appearances=[{"id": 3, "physician_id": 100, "conference_year_id": 5}, {"id": 8, "physician_id": 7, "conference_year_id": 9}, {"id": 9, "physician_id": 1, "conference_year_id": 5}],
        scrape_runs=[{"id": "r", "home_url": "u", "conference_id": None}, {"id": "s", "home_url": "u", "conference_id": 11}],
        run_events=[{"id": 1, "run_id": "r"}, {"id": 2, "run_id": "s"}, {"id": 3, "run_id": "r", "conference_year_id": 9}],
        run_conference_years=[{"id": 50, "run_id": "r", "conference_year_id": 5}],
    )


def test_order_of_keys():
    order = integrity.load_order(integrity.FOREIGN_KEYS)
    assert set(order) == set(tables.BACKUP_TABLES)
    assert all(order.index(p) < order.index(t) for t, fks in integrity.FOREIGN_KEYS.items() for p in fks.values())
    with pytest.raises(ValueError, match="round"):
        integrity.load_order({"a": {"x": "b"}, "b": {"y": "a"}})


def test_orphans_go_with_what_hangs_on_them(spark):
    kept = integrity.ordered(small(spark))
    assert (ids(kept["conference_years"]), ids(kept["appearances"]), ids(kept["scrape_runs"]), ids(kept["run_events"])) == ([5], [3], ["r"], [1])
    told = {r["table_name"]: (r["rows"], r["loaded"], r["orphans"]) for r in integrity.orphans(small(spark)).collect()}
    assert told["appearances"] == (3, 1, 2) and told["physicians"] == (2, 2, 0) and told["sources"] == (0, 0, 0)


def test_sequences_and_round_trip(spark, tmp_path):
    backup.export({t: df for t, df in small(spark).items() if t in tables.BACKUP_TABLES}, str(tmp_path))
    loaded, sequences, counts = backup.reload(spark, str(tmp_path))
    s = {r["table_name"]: (r["last_value"], r["is_called"], r["next_id"]) for r in sequences.collect()}
    assert s["physicians"] == (100, True, 101) and s["sources"] == (1, False, 1) and "scrape_runs" not in s
    assert ids(loaded["appearances"]) == [3] and counts.where("orphans > 0").count() == 4
    assert all(df.count() == 0 for df in backup.wipe(spark).values())


def test_dense_ids_keep_order_and_references(spark):
    out = integrity.renumbered(small(spark))
    people = {r["full_name"]: r["id"] for r in out["physicians"].collect()}
    assert people == {"Y": 1, "X": 2}
    assert [(r["id"], r["physician_id"], r["conference_year_id"]) for r in out["appearances"].collect()] == [(1, 2, 1)]
    assert out["run_events"].select("id", "run_id", "conference_year_id").collect() == [(1, "r", None)]
    df = spark.createDataFrame([(i * i,) for i in range(500)], "id long")
    for width in (1, 7, 4096, 10**9):
        got = integrity.dense_ids(df, width).orderBy("id").collect()
        assert [r["new"] for r in got] == list(range(1, 501))


def test_schema_versions_up(spark):
    first = {t: spark.createDataFrame([], ", ".join(f"{c} {integrity._types(t)[c]}" for c in names)) for t, names in integrity.columns_at(1).items()}
    assert "home_url" not in first["scrape_runs"].columns and "navigation_template_memory" not in first
    first["scrape_runs"] = spark.sql("SELECT 'r' AS id, 5L AS conference_id, 1 AS start_year, 2 AS end_year, 'pending' AS status, CAST(NULL AS string) AS error_message, now() AS created_at, CAST(NULL AS timestamp) AS finished_at")
    at = first
    for version in range(1, integrity.LATEST):
        assert not integrity.wrong_columns(at, version)
        # The last step sets values only.
        assert bool(integrity.wrong_columns(at, integrity.LATEST)) == (version < integrity.LATEST - 1)
        at = integrity.upgrade(at, version, version + 1)
    assert not integrity.wrong_columns(at) and {t: df.columns for t, df in at.items()} == {t: df.columns for t, df in integrity.upgrade(first, 1).items()}
    assert at["scrape_runs"].select("id", "home_url", "conference_name").collect() == [("r", "", None)]
    photos = {"physicians": spark.sql("SELECT 1L AS id").withColumns({c: __import__("pyspark").sql.functions.lit("x" if k == "string" else None).cast(k) for c, k in integrity._types("physicians").items() if c != "id"})}
    before = {t: spark.createDataFrame([], ", ".join(f"{c} {integrity._types(t)[c]}" for c in names)) for t, names in integrity.columns_at(7).items()} | photos
    assert integrity.upgrade(before, 7)["physicians"].select("photo_url", "photo_source_url", "bio_short").collect() == [(None, None, "x")]
    with pytest.raises(ValueError, match="upwards"):
        integrity.upgrade(first, 3, 2)
