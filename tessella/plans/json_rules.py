"""Queries over JSON in scripts, payloads and model replies, built from whole documents, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import dom, extract, records, udtfs
from .marts import read


def _json(x: Column) -> Column:
    """A string as JSON."""
    return F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")


def _docs(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").where("text is not null")


def _session_json() -> Column:
    session = F.struct(F.substring("text", 1, 30).alias("title"), F.col("text").alias("abstract"), F.col("source"))
    return F.to_json(F.struct(F.array(session).alias("sessions"), F.struct(F.lit("Acme").alias("name")).alias("host")))


def embedded_json(s: SparkSession, d: str) -> DataFrame:
    """Described nodes in the scripts of pages; each document is the data of a page's script, in one of seven ways."""
    data = F.replace(_session_json(), F.lit("</"), F.lit("<\\/"))
    ways = [
        ('<script type="application/ld+json">', "</script>"),
        ('<script id="__NEXT_DATA__" type="application/json">', "</script>"),
        ("<script>window.__NUXT__ = ", "; var z = {a: 1};</script>"),
        ("<script>window.__APOLLO_STATE__=", "</script>"),
        ("<script>load(drupalSettings, '{'); x = ", ";</script>"),
        ("<script>var dataLayer = [", "];</script>"),
        ("<script>var other = ", ";</script>"),
    ]
    way = F.pmod("doc_id", F.lit(len(ways)))
    body = F.lit("")
    for i, (start, end) in enumerate(ways):
        body = F.when(way == i, F.concat(F.lit(start), data, F.lit(end))).otherwise(body)
    pages = _docs(s, d).select("doc_id", F.concat(F.lit("<html><body><p>page</p>"), body, F.lit("</body></html>")).alias("html"))
    n = extract.embedded_table(dom.parsed(pages), "doc_id", None)
    return n.select("doc_id", "pos", "source", "kind", F.get_json_object("node", "$.title").alias("title"), F.md5(F.get_json_object("node", "$.abstract").cast("binary")).alias("abstract"))


def network_signals(s: SparkSession, d: str) -> DataFrame:
    """Payloads with a session or speaker key somewhere; a value that only looks like one doesn't count."""
    quoted = _json(F.concat(F.lit('"speakers": '), "text"))
    way = F.pmod("doc_id", F.lit(4))
    payload = F.when(way == 0, F.concat(F.lit('{"data": {"x": [1, {"Speakers": '), _json(F.col("text")), F.lit("}]}}"))).when(way == 1, F.concat(F.lit('{"note": '), quoted, F.lit("}"))).when(way == 2, F.concat(F.lit('[{"y": null}, [{"BIO" : '), _json(F.col("source")), F.lit("}]]"))).otherwise(F.concat(F.lit('{"speakers": '), "text"))
    return _docs(s, d).select("doc_id", extract.has_signals(payload).alias("signals"))


def _reply() -> Column:
    words = F.filter(F.split("text", "[ \\n]+"), lambda w: w != "")
    name = F.array_join(F.slice(words, 1, F.pmod("doc_id", F.lit(7)).cast("int")), "  ")
    way = F.pmod("doc_id", F.lit(5))
    tenth = (F.pmod("doc_id", F.lit(13)) / 10).cast("string")
    sure = F.when(way == 0, tenth).when(way == 1, F.concat(F.lit('"'), tenth, F.lit('"'))).when(way == 2, "true").when(way == 3, "[1]").otherwise('"high"')
    flag = F.when(F.pmod("doc_id", F.lit(3)) == 0, ', "is_physician_candidate": false').when(F.pmod("doc_id", F.lit(3)) == 1, ', "is_physician_candidate": "yes"').otherwise("")
    degree = F.when(F.pmod("doc_id", F.lit(2)) == 0, '"x, M.D."').otherwise("null")
    year = F.lit(1985) + F.pmod("doc_id", F.lit(20))
    target = F.concat(F.lit('[{"conference_name": '), _json(F.col("source")), F.lit(', "year": '), year.cast("string"), F.lit(', "confidence": 0.5}, {"year": 2000}, 7]'))
    one = F.concat(F.lit('{"full_name": "", "name": '), _json(name), F.lit(', "designation": '), degree, F.lit(', "confidence": '), sure, flag, F.lit(', "location": 7, "role": 0, "session_title": '), _json(F.substring("text", 5, 400)), F.lit(', "evidence_span": '), _json(F.col("text")), F.lit(', "aliases": ['), _json(name), F.lit(", "), _json(F.col("lang")), F.lit(', null, 5], "attribution_targets": '), target, F.lit("}"))
    return F.when(F.pmod("doc_id", F.lit(2)) == 0, F.concat(F.lit('{"records": [5, '), one, F.lit("]}"))).otherwise(F.concat(F.lit("["), one, F.lit(', "x"]')))


def _coerced(s: SparkSession, d: str, form: records.Form) -> DataFrame:
    r = _docs(s, d).select("doc_id", F.explode(records.records(_reply(), form)).alias("r"))
    whole = lambda c: F.md5(F.coalesce(c, F.lit("")).cast("binary"))
    return r.select("doc_id", "r.full_name", "r.designation", "r.location", "r.role", "r.confidence", "r.is_physician_candidate", whole(F.col("r.session_title")).alias("session"), whole(F.col("r.evidence_span")).alias("evidence"), F.array_join("r.aliases", "|").alias("aliases"), F.array_join(F.transform("r.attribution_targets", lambda t: F.concat_ws("/", t["conference_name"], t["year"].cast("string"))), "|").alias("targets"))


def record_coercion(s: SparkSession, d: str) -> DataFrame:
    return _coerced(s, d, records.EXTRACTION)


def record_coercion_reasoning(s: SparkSession, d: str) -> DataFrame:
    return _coerced(s, d, records.REASONING)


def lateral_nodes(s: SparkSession, d: str) -> DataFrame:
    """The table function json_nodes beside each document's payload, in SQL."""
    udtfs.register(s)
    payloads = _docs(s, d).select("doc_id", _session_json().alias("payload"))
    return s.sql("SELECT doc_id, pos, node:title::string AS title, md5(cast(node:abstract::string AS binary)) AS abstract FROM (SELECT doc_id, pos, parse_json(node) AS node FROM {payloads}, LATERAL json_nodes(payload))", payloads=payloads)


def lateral_elements(s: SparkSession, d: str) -> DataFrame:
    """The table function page_elements in SQL: a page's paragraphs and what stands right in its article."""
    udtfs.register(s)
    p = read(s, d, "pages").select("page_id", "html")
    return s.sql("SELECT page_id, count_if(e.tag = 'p') AS paragraphs, count_if(e.tag = 'a' AND e.framed) AS nav_links, sum(if(e.tag IN ('p', 'h1'), length(e.text), 0)) AS characters FROM {p} q, LATERAL page_elements(q.html) e GROUP BY page_id", p=p)


QUERIES = {f.__name__: f for f in (embedded_json, network_signals, record_coercion, record_coercion_reasoning, lateral_nodes, lateral_elements)}


def _squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _coercion(form: records.Form) -> str:
    """The records that the documents' replies describe, said once more from how they were made."""
    name = r"array_to_string(list_filter(regexp_split_to_array(text, '[ \n]+'), lambda w: w <> '')[1:doc_id % 7], ' ')"
    banned = "|".join(K.NON_PERSON_PHRASES)
    good = f"len(string_split(name, ' ')) BETWEEN 2 AND 5 AND regexp_matches(lower(name), '[a-z]') AND NOT regexp_matches(lower(name), '{banned}')" if form.checked else "name <> ''"
    own = "CASE WHEN lower(lang) <> lower(name) THEN [lang] ELSE [] END || ['None', '5']" if form.checked else "[name[1:140], lang, '5']"
    flag = "CASE WHEN doc_id % 3 = 0 THEN false ELSE doc_id % 2 = 0 END" if form.checked else "doc_id % 3 <> 0"
    return f"""SELECT doc_id, name AS full_name, CASE WHEN doc_id % 2 = 0 THEN 'x, M.D.' END AS designation, '7' AS location, CAST(NULL AS VARCHAR) AS role,
  CASE WHEN doc_id % 5 IN (0, 1) THEN least(1.0, doc_id % 13 / 10.0) WHEN doc_id % 5 = 2 THEN 1.0 ELSE {form.confidence} END AS confidence, {flag} AS is_physician_candidate,
  md5(left({_squeeze('substr(text, 5, 400)')}, {form.session})) AS session, md5(left({_squeeze('text')}, {form.evidence})) AS evidence,
  array_to_string({own}, '|') AS aliases, CASE WHEN 1985 + doc_id % 20 >= 1990 THEN source || '/' || (1985 + doc_id % 20) ELSE '' END AS targets
FROM (SELECT *, {name} AS name FROM documents WHERE text IS NOT NULL) WHERE {good}"""


ORACLES = {
    "embedded_json": "SELECT doc_id, 0 AS pos, ['ld_json', 'next_data', 'nuxt', 'apollo_state', 'drupal_settings', 'data_layer'][doc_id % 7 + 1] AS source, 'session' AS kind, left(text, 30) AS title, md5(text) AS abstract FROM documents WHERE text IS NOT NULL AND doc_id % 7 < 6",
    "network_signals": "SELECT doc_id, doc_id % 4 IN (0, 2) AS signals FROM documents WHERE text IS NOT NULL",
    "record_coercion": _coercion(records.EXTRACTION),
    "record_coercion_reasoning": _coercion(records.REASONING),
    "lateral_nodes": "SELECT doc_id, 0 AS pos, left(text, 30) AS title, md5(text) AS abstract FROM documents WHERE text IS NOT NULL",
    "lateral_elements": r"SELECT page_id, len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, '<a ')) AS nav_links, CAST((SELECT sum(length(trim(regexp_replace(regexp_replace(replace(replace(split_part(split_part(x, '</p>', 1), '</h1>', 1), '&quot;', chr(34)), '&copy;', '©'), '<[^>]*>', ' ', 'g').replace('&amp;', '&').replace('&amp', '&'), '\s+', ' ', 'g')))) FROM (SELECT unnest(regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>|<h1>')) AS x)) AS BIGINT) AS characters FROM pages",
}
