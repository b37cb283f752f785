"""JSON in scripts and replies: brackets, markers, signals, loose records, table functions."""

import json
import random

from pyspark.sql import functions as F

from tessella.functions import dom, extract, records, udtfs


def test_balanced_equals_a_counting_scan():
    def scan(text):
        pair = {"{": "}", "[": "]"}.get(text[:1])
        depth = i = 0
        quoted = False
        while pair and i < len(text):
            c = text[i]
            if quoted:
                i += c == "\\"
                quoted = c != '"'
            elif c == '"':
                quoted = True
            elif c in (text[0], pair):
                depth += 1 if c == text[0] else -1
                if not depth:
                    return text[: i + 1]
            i += 1
        return None

    rng = random.Random(2)
    for _ in range(4000):
        text = "".join(rng.choice('{}[]"\\a:,\n') for _ in range(rng.randrange(0, 14)))
        assert extract.balanced(text) == scan(text), text
        text = "{" + text
        assert extract.balanced(text) == scan(text), text


PERSON = {"name": "Jane Doe", "title": "MD", "affiliation": "Clinic"}
SESSION = {"title": 'A } "quoted" ] talk', "speakers": [PERSON, {"name": "B"}]}


def nodes(spark, html):
    p = dom.parsed(spark.createDataFrame([(1, html)], "id int, html string"))
    return [(r["source"], r["kind"], json.loads(r["node"])) for r in extract.embedded_table(p, "id").orderBy("pos").collect()]


def test_scripts_of_every_source(spark):
    p, s = json.dumps(PERSON), json.dumps(SESSION)
    assert nodes(spark, f"<script type='application/ld+json'>{p}</script>") == [("ld_json", "person", PERSON)]
    assert nodes(spark, f'<SCRIPT TYPE="Application/LD+JSON"> {p} </SCRIPT><script type="application/ld+json">{{bad</script>') == [("ld_json", "person", PERSON)]
    assert nodes(spark, f'<script id="__NEXT_DATA__">{{"props": {s}}}</script>') == [("next_data", "session", SESSION), ("next_data", "person", PERSON)]
    for marker, source in (("window.__NUXT__", "nuxt"), ("__APOLLO_STATE__", "apollo_state"), ("Drupal.drupalSettings", "drupal_settings"), ("var dataLayer", "data_layer")):
        assert nodes(spark, f"<script>f('{{'); {marker} = x || [{s}, {p}]; g({{}})</script>") == [(source, "session", SESSION), (source, "person", PERSON)]
    assert nodes(spark, f"<script>dataLayer = {p[:-1]}</script><script>other = {p}</script><script></script><p>{p}</p>") == []
    both = f"<script>dataLayer = [{p}]; window.__NUXT__ = {p}</script>"
    assert nodes(spark, both) == [("nuxt", "person", PERSON), ("data_layer", "person", PERSON)]
    many = "<script>dataLayer = " + json.dumps([{"name": f"n{i}", "bio": "b"} for i in range(500)]) + "</script>"
    assert len(nodes(spark, many)) == 400


def test_network_signals(spark):
    rows = {'{"a": [{"SPEAKERS": 1}]}': True, '{"a": "\\"speakers\\": 1"}': False, '{"speakers_x": 1}': False, '[{"bio" : null}]': True, "bad speakers": False, '"speaker"': False, "": False, '{"\\u0062io": 1}': True}
    df = spark.createDataFrame([(x,) for x in rows] + [(None,)], "x string").select("x", extract.has_signals(F.col("x")).alias("s"))
    assert {r["x"]: r["s"] for r in df.collect()} == rows | {None: False}
    got = extract.network_table(spark.createDataFrame([(1, '{"sessions": [{"title": "S", "time": 1}]}'), (2, '{"x": {"name": "n", "role": "r"}}')], "id int, text string")).collect()
    assert [(r["id"], r["node"]) for r in got] == [(1, '{"time": 1, "title": "S"}')]


def test_loose_records(spark):
    def read(payload, form=records.EXTRACTION):
        return [r.asDict(True) for r in spark.createDataFrame([(payload if isinstance(payload, (str, type(None))) else json.dumps(payload),)], "p string").select(records.records(F.col("p"), form).alias("r")).first()["r"]]

    full = {"full_name": "", "name": " Anna \n Berg ", "designation": " M.D. ", "confidence": "1.7", "aliases": ["ANNA BERG", "A. Berg", None, 5], "evidence_span": "x" * 900, "role": 0, "location": 12, "attribution_targets": [{"conference_name": "C", "year": "2024", "confidence": 1}, {"conference_name": "C", "year": 2024.5, "confidence": 1}, {"conference_name": "C", "year": 2024}, {"conference_name": 1, "year": 2024, "confidence": 0}, 3]}
    (r,) = read({"records": [full, {"name": "Register Now Please"}, {"name": "Single"}, 7, {"x": 1}]})
    assert (r["full_name"], r["designation"], r["confidence"], r["is_physician_candidate"], r["role"], r["location"]) == ("Anna Berg", "M.D.", 1.0, True, None, "12")
    assert r["aliases"] == ["A. Berg", "None", "5"] and len(r["evidence_span"]) == 800
    assert r["attribution_targets"] == [{"conference_name": "C", "year": 2024, "confidence": 1.0, "reason": None}]
    (r,) = read([{"full_name": "Anna Berg", "confidence": {}, "is_physician_candidate": False, "designation": "MD"}])
    assert (r["confidence"], r["is_physician_candidate"]) == (0.7, False)
    r, s = read({"records": [full, {"name": "Single", "is_physician_candidate": 0}]}, records.REASONING)
    assert (r["confidence"], r["is_physician_candidate"], r["aliases"], len(r["evidence_span"])) == (1.0, True, ["ANNA BERG", "A. Berg", "5"], 900)
    assert (s["full_name"], s["is_physician_candidate"], s["confidence"]) == ("Single", False, 0.65)
    for nothing in ("", "bad", "5", '{"records": 1}', "{}", "[]", None):
        assert read(nothing) == []


def test_table_functions_in_sql(spark):
    udtfs.register(spark)
    rows = spark.sql("SELECT id, parent, tag, text FROM page_elements('<ul><li>a <b>b</b><li>c</ul>') ORDER BY id").collect()
    assert [tuple(r) for r in rows] == [(0, -1, "ul", "a b c"), (1, 0, "li", "a b"), (2, 1, "b", "b"), (3, 0, "li", "c")]
    rows = spark.sql("SELECT t.id, p.speaker FROM VALUES (1, 'A talk on all the eyes - Anna Berg'), (2, null) t(id, x), LATERAL session_pairs_raw(x) p").collect()
    assert [tuple(r) for r in rows] == [(1, "Anna Berg")]
    assert spark.sql("SELECT count(*) FROM json_nodes('[{\"name\": \"a\", \"bio\": 1}, 2]')").first()[0] == 1
