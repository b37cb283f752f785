"""Queries of page rules, link hints, upserts and run control, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import attribution as A
from ..functions import constants as K
from ..functions import html as H
from ..functions import pages as P
from ..functions import text as T
from ..functions import url as U
from ..operators import dedupe, navigation, windows
from .marts import read
from .oracles import _ANY, _PATH, _SITE, _TITLE, _YEAR_LIST

def _targets(s: SparkSession, d: str) -> DataFrame:
    """(person, conference, year) of every appearance."""
    c = read(s, d, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(read(s, d, "nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    return read(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", "n_name", F.year("o_orderdate").alias("year"))


def thin_pages(s: SparkSession, d: str) -> DataFrame:
    links = F.size(F.regexp_extract_all("text", F.lit("https?://"), F.lit(0)))
    kind = F.when(F.col("doc_id") % 50 == 0, "pdf").otherwise("html")
    return read(s, d, "documents").select("doc_id", P.is_thin(kind, F.col("text"), links, F.lit(0)).alias("thin"))


def fetch_choice(s: SparkSession, d: str) -> DataFrame:
    """Documents as the static fetch of the page with their id, its HTML as the rendered one."""
    pages = read(s, d, "pages").join(read(s, d, "documents").select(F.col("doc_id").alias("page_id"), "text"), "page_id")
    kind = F.when(F.col("url").contains("pdf"), "pdf").otherwise("html")
    return pages.select("page_id", P.better_fetch(kind, F.col("text"), F.col("html")).alias("method"))


def sitemap_urls(s: SparkSession, d: str) -> DataFrame:
    """Distinct locations on a page's own site, where each page's URL is an entry of a sitemap."""
    xml = F.concat(F.lit("<urlset><url><loc> "), "url", F.lit(" </loc></url><url><lastmod>2024</lastmod><loc>https://elsewhere.invalid/</loc></url></urlset>"))
    p = read(s, d, "pages").select(U.registrable(F.col("url")).alias("site"), F.explode(P.sitemap_locations(xml)).alias("loc"))
    return p.where(U.registrable(F.col("loc")) == F.col("site")).select("site", "loc").distinct()


def search_queries(s: SparkSession, d: str) -> DataFrame:
    both = _targets(s, d).select("n_name", "year").distinct()
    return both.select("n_name", "year", F.posexplode(P.search_queries(F.col("n_name"), F.col("year"))).alias("position", "query"))


def title_parts(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "pages").select("page_id", F.array_join(P.title_parts(F.concat_ws(" | ", H.title(F.col("html")), "url")), "#").alias("parts"))


def file_slugs(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "pages").select("page_id", P.file_slug(H.title(F.col("html"))).alias("slug"), P.conference_name(H.title(F.col("html"))).alias("name"))


def first_last_names(s: SparkSession, d: str) -> DataFrame:
    c = read(s, d, "part").select("p_partkey", P.first_last(F.col("p_name")).alias("n"))
    return c.select("p_partkey", "n.first", "n.last")


def link_texts(s: SparkSession, d: str) -> DataFrame:
    p = read(s, d, "pages")
    return p.select("page_id", P.link_text(F.when(F.col("page_id") % 2 == 0, H.title(F.col("html"))), U.path(F.col("url"))).alias("text"))


def pdf_links(s: SparkSession, d: str) -> DataFrame:
    p = read(s, d, "pages").select("page_id", F.explode(H.links(F.col("html"))).alias("l"))
    return p.groupBy("page_id").agg(F.count_if(P.is_pdf_link(F.col("l.href"), F.col("l.anchor"))).alias("n"))


def triage_by_site(s: SparkSession, d: str) -> DataFrame:
    """The first eight results of each site, classed by the fallback ladder."""
    p = read(s, d, "pages").select("page_id", "url", U.registrable(F.col("url")).alias("site"), H.title(F.col("html")).alias("title"))
    top = dedupe.first_by(p, ["site"], [F.col("page_id")], 8)
    return top.select("page_id", P.triage(F.col("url"), F.col("title"), F.lit(None)).alias("t")).select("page_id", "t.*")


def seed_page_types(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 50 == 0, "pdf").otherwise("html")
    return read(s, d, "documents").select("doc_id", P.seed_page_type(kind, F.col("source"), F.col("text")).alias("page_type"))


def newest_years(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", F.array_join(P.newest_years(T.years(F.col("text")), 2024).cast("array<string>"), ",").alias("years"))


def year_hints(s: SparkSession, d: str) -> DataFrame:
    """Hints of each page: years of its URL under its site's name, then years of its HTML under its title."""
    p = read(s, d, "pages").select("page_id", U.registrable(F.col("url")).alias("site"), T.years(F.col("url")).alias("u"), H.title(F.col("html")).alias("title"), T.years(F.col("html")).alias("y"))
    known = F.transform("u", lambda y: F.struct(F.col("site").alias("name"), y.alias("year")))
    hints = F.transform(P.year_hints(known, F.col("title"), F.col("y")), lambda t: F.concat_ws("@", t["name"], t["year"].cast("string")))
    return p.select("page_id", F.array_join(hints, "|").alias("hints"))


def record_targets(s: SparkSession, d: str) -> DataFrame:
    """Each person's distinct valid (conference, year) targets, one row a link."""
    o = _targets(s, d)
    each = o.groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.struct(F.col("n_name").alias("name"), "year"))).alias("targets"))
    rows = each.select("o_custkey", F.posexplode("targets").alias("position", "t")).select("o_custkey", "position", "t.name", "t.year")
    return rows.where(P.valid_target(F.col("name"), F.col("year")))


def upsert_people(s: SparkSession, d: str) -> DataFrame:
    """Orders up to 1995 as stored rows, later ones as incoming: greatest price, first known priority."""
    o = read(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("o_orderpriority"), F.year("o_orderdate").alias("y"))
    return dedupe.upsert(o.where("y < 1996"), o.where("y >= 1996"), "o_custkey", "o_orderkey", ["o_totalprice"], ["o_orderpriority"])


def ordered_sources(s: SparkSession, d: str) -> DataFrame:
    """Nations of suppliers, then of customers: the first source that names one."""
    a = read(s, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"))
    b = read(s, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"))
    return dedupe.ordered_union([a, b], ["nation"], "id")


def interaction_novelty(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events").select("event_id", "user_id", "event_type", "value")
    return windows.interactions(e, (F.col("event_type") == "click").cast("int"), F.col("value"), ["user_id"], "event_id").select("event_id", "novel", "streak")


def watchdog_flags(s: SparkSession, d: str) -> DataFrame:
    return windows.watchdog(read(s, d, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts", "event_id").select("event_id", "stalled", "stalls", "terminal")


def unanimous_votes(s: SparkSession, d: str) -> DataFrame:
    c = read(s, d, "conversations").select("conv_id", "turn", "role", "text")
    links = F.size(F.regexp_extract_all("text", F.lit("https?://"), F.lit(0)))
    out = windows.unanimous(c, ["conv_id"], ~F.col("text").contains("?"), links, F.when(F.col("role") == "assistant", F.md5("text")), "turn")
    return out.select("conv_id", "stop", "reason")


def events_by_url(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events").select("user_id", F.coalesce(F.get_json_object("props", "$.url"), F.get_json_object("props", "$.from_url"), F.lit("general")).alias("url"), "event_id")
    return e.groupBy("user_id", "url").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))


def key_with_variants(s: SparkSession, d: str) -> DataFrame:
    """Stored names that are a looked-up key or one of its variants (key::...)."""
    stored = read(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).otherwise(F.concat(F.lower("c_mktsegment"), F.lit("::"), F.col("c_nationkey").cast("string"))).alias("name_key"))
    wanted = read(s, d, "customer").where("c_custkey < 3").select(F.lower("c_mktsegment").alias("key")).distinct()
    # The key before "::" makes the LIKE a join on equal values.
    return stored.join(F.broadcast(wanted), F.substring_index("name_key", "::", 1) == F.col("key"), "left_semi").select("c_custkey", "name_key")


def relaxed_targets(s: SparkSession, d: str) -> DataFrame:
    """Targets of pages by URL, title and page years, under the page's site; a known target fills in."""
    p = read(s, d, "pages").select("page_id", U.registrable(F.col("url")).alias("site"), T.years(F.col("url")).alias("u"), T.years(H.title(F.col("html"))).alias("t"), T.years(F.col("html")).alias("y"))
    known = F.when(F.col("page_id") % 2 == 0, F.array(F.struct(F.lit("Known").alias("name"), F.lit(2021).alias("year")))).otherwise(F.array().cast("array<struct<name:string,year:int>>"))
    year = A.relaxed_year(F.col("u"), F.col("t"), F.slice("y", 1, 0), F.col("y"), known)
    target = A.relaxed_target(F.lit(None).cast("string"), F.when(F.col("page_id") % 3 == 0, F.col("site")), known, year, F.col("page_id") % 10 / 10.0)
    none = F.array().cast("array<struct<name:string,year:int,confidence:double,reason:string>>")
    return p.select("page_id", F.explode(A.resolve_targets(none, none, target)).alias("t")).select("page_id", "t.*")


def linkable_records(s: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("doc_id") % 7 == 0, "Session Chair")
    docs = read(s, d, "documents")
    return docs.select("doc_id", P.is_linkable(F.lit(None).cast("boolean"), role, F.col("source"), F.col("doc_id") % 10 / 10.0, F.col("text")).alias("linkable"))


def nav_noise_blocks(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "pages").select("page_id", P.is_nav_noise(F.col("html")).alias("noise"))


def expand_decisions(s: SparkSession, d: str) -> DataFrame:
    intent = F.element_at(F.array(F.lit("listing"), F.lit("archive"), F.lit("gatekeeper")), (F.col("page_id") % 3 + 1).cast("int"))
    x = P.expand_decision(F.lit(True), F.col("page_id") % 11 == 0, intent, (F.col("page_id") % 5).cast("int"), F.lit(0), F.concat_ws(" ", "url", "html"))
    return read(s, d, "pages").select("page_id", x.alias("x")).select("page_id", "x.*")


def prioritised_blocks(s: SparkSession, d: str) -> DataFrame:
    """Turns as blocks of a page: marked ones first, as many as the page's segments leave room for."""
    mark = F.when(F.col("turn") % 3 == 2, "[BLOCK person_span] ").when(F.col("turn") % 3 == 1, "[BLOCK dom_card] ").otherwise("")
    c = read(s, d, "conversations").select("conv_id", "turn", P.block_priority(F.concat(mark, "text")).alias("priority"))
    top = dedupe.first_by(c, ["conv_id"], [F.desc("priority"), F.col("turn")], 20)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("priority"), "turn"))
    return top.withColumn("_at", place).where(F.col("_at") <= P.block_limit(F.col("conv_id") % 8)).drop("_at")


def filtered_links(s: SparkSession, d: str) -> DataFrame:
    """Links of each page by fate: kept, or why dropped."""
    p = read(s, d, "pages").select("page_id", "url", "html")
    base = p.select("page_id", F.col("url").alias("base"), H.title(F.col("html")).alias("title"))
    rows = navigation.internal_links(p).withColumnRenamed("anchor", "text").join(base, "page_id")
    focus = T.nav_tokens(F.concat_ws(" ", U.path(F.col("base")), F.col("title")))
    return navigation.filter_links(rows, "base", "base", focus, F.lit(False), ["page_id"], "pos").select("page_id", "pos", "url", "why")


QUERIES = {f.__name__: f for f in (relaxed_targets, linkable_records, nav_noise_blocks, expand_decisions, prioritised_blocks, filtered_links, thin_pages, fetch_choice, sitemap_urls, search_queries, title_parts, file_slugs, first_last_names, link_texts, pdf_links, triage_by_site, seed_page_types, newest_years, year_hints, record_targets, upsert_people, ordered_sources, interaction_novelty, watchdog_flags, unanimous_votes, events_by_url, key_with_variants)}

_STRIP = lambda x: f"trim({x}, E' \\t\\n\\x0B\\f\\r\\x1c\\x1d\\x1e\\x1f')"
_LINKS = "len(regexp_extract_all(text, 'https?://'))"
_Q = lambda x: x.replace("'", "''")
_COLLAPSED = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"

ORACLES = {
    "thin_pages": f"SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN length({_STRIP('text')}) < 40 ELSE length({_STRIP('text')}) < 300 AND {_LINKS} = 0 END AS thin FROM documents",
    "fetch_choice": f"SELECT page_id, CASE WHEN NOT contains(url, 'pdf') AND length({_STRIP('text')}) < 1200 AND length({_STRIP('html')}) > length({_STRIP('text')}) THEN 'rendered' ELSE 'static' END AS method FROM pages JOIN documents ON page_id = doc_id",
    "sitemap_urls": f"SELECT DISTINCT {_SITE} AS site, url AS loc FROM pages",
    "search_queries": "SELECT n_name, year, CAST(i AS INTEGER) AS position, '\"' || n_name || '\" ' || year || ' ' || " + "[" + ", ".join(f"'{x}'" for x in K.SEARCH_SUFFIXES) + "][i + 1] AS query FROM (SELECT DISTINCT n_name, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), range(5) r(i)",
    "title_parts": f"SELECT page_id, array_to_string(list_filter(list_transform(regexp_split_to_array({_TITLE} || ' | ' || url, '[|\\-–—:]'), lambda p: {_COLLAPSED('p')}), lambda p: p <> ''), '#') AS parts FROM pages",
    "file_slugs": f"SELECT page_id, coalesce(nullif(trim(regexp_replace(lower({_TITLE}), '[^\\p{{L}}\\p{{N}}_-]', '-', 'g'), '-_'), ''), 'backup') AS slug, substr({_TITLE}, 1, 255) AS name FROM pages",
    "first_last_names": "SELECT p_partkey, CASE WHEN len(t) >= 2 THEN t[1] END AS first, CASE WHEN len(t) >= 2 THEN t[-1] END AS last FROM (SELECT p_partkey, list_filter(string_split(p_name, ' '), lambda x: x <> '') AS t FROM part)",
    "link_texts": f"SELECT page_id, coalesce(CASE WHEN page_id % 2 = 0 THEN nullif({_TITLE}, '') END, substr(string_split(trim({_PATH}, '/'), '/')[-1], 1, 120)) AS text FROM pages",
    "pdf_links": "SELECT page_id, count(*) FILTER (" + _ANY("lower(regexp_extract(a, '(?is)href=[\"'']([^\"'']*)[\"'']', 1) || ' ' || regexp_replace(a, '(?s)<[^>]*>', ' ', 'g'))", K.PDF_HINTS) + ") AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href=[\"''][^\"'']*[\"''][^>]*>.*?</a>')) AS a FROM pages) GROUP BY page_id",
    "triage_by_site": f"WITH p AS (SELECT page_id, lower({_TITLE} || '  ' || url) AS low, row_number() OVER (PARTITION BY {_SITE} ORDER BY page_id) AS rn FROM pages) SELECT page_id, CASE WHEN contains(low, 'pdf') THEN 'pdf_program' WHEN {_ANY('low', ['speaker', 'faculty'])} THEN 'official_speakers' WHEN {_ANY('low', ['program', 'agenda', 'schedule'])} THEN 'official_program' WHEN {_ANY('low', ['cvent', 'swapcard', 'whova'])} THEN 'platform' ELSE 'unknown' END AS category, CASE WHEN contains(low, 'pdf') THEN 'pdf_text' WHEN NOT {_ANY('low', ['speaker', 'faculty', 'program', 'agenda', 'schedule'])} AND {_ANY('low', ['cvent', 'swapcard', 'whova'])} THEN 'playwright_dom' ELSE 'http_static' END AS method, 0.45::DOUBLE AS score FROM p WHERE rn <= 8",
    "seed_page_types": f"SELECT doc_id, CASE WHEN {_ANY('low', K.SPEAKER_TERMS)} THEN 'speakers' WHEN {_ANY('low', ['agenda', 'program', 'session'])} THEN 'program' WHEN doc_id % 50 = 0 THEN 'pdf' ELSE 'homepage' END AS page_type FROM (SELECT doc_id, lower(coalesce(source, '') || ' ' || coalesce(text, '')) AS low FROM documents)",
    "newest_years": f"SELECT doc_id, array_to_string(list_sort((CASE WHEN len(n) > 0 THEN n ELSE y END)[1:3]), ',') AS years FROM (SELECT doc_id, y, list_filter(y, lambda v: v BETWEEN 2023 AND 2026) AS n FROM (SELECT doc_id, list_reverse_sort({_YEAR_LIST.format(x='text')}) AS y FROM documents))",
    "year_hints": f"""WITH p AS (SELECT page_id, {_SITE} AS site, {_TITLE} AS title, {_YEAR_LIST.format(x='url')} AS u, {_YEAR_LIST.format(x='html')} AS y FROM pages),
h AS (SELECT page_id, 0 AS src, site AS name, unnest(u) AS year FROM p UNION ALL SELECT page_id, 1, substr(title, 1, 255), unnest(y) FROM p WHERE title <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(name), year ORDER BY src) AS rn FROM h), t AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY src, year) AS place FROM f WHERE rn = 1)
SELECT p.page_id, coalesce(string_agg(name || '@' || year, '|' ORDER BY place) FILTER (place <= 8), '') AS hints FROM p LEFT JOIN t ON p.page_id = t.page_id GROUP BY p.page_id""",
    "record_targets": "SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY name, year) - 1 AS INTEGER) AS position, name, year FROM (SELECT DISTINCT o_custkey, n_name AS name, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)",
    "upsert_people": "SELECT o_custkey, max(o_totalprice) AS o_totalprice, arg_min(p, (late, o_orderkey)) FILTER (p IS NOT NULL) AS o_orderpriority, bool_or(NOT late) AS stored FROM (SELECT *, nullif(o_orderpriority, '4-NOT SPECIFIED') AS p, year(o_orderdate) >= 1996 AS late FROM orders) GROUP BY o_custkey",
    "ordered_sources": "SELECT nation, CASE WHEN min(s) IS NULL THEN min(c) ELSE min(s) END AS id, CASE WHEN min(s) IS NULL THEN 1 ELSE 0 END AS source FROM (SELECT s_nationkey AS nation, s_suppkey AS s, NULL AS c FROM supplier UNION ALL SELECT c_nationkey, NULL, c_custkey FROM customer) GROUP BY nation",
    "interaction_novelty": """WITH e AS (SELECT event_id, user_id, event_type = 'click' OR value >= 180 AS novel FROM events), i AS (SELECT *, sum(novel::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM e),
s AS (SELECT *, CAST(sum((NOT novel)::INT) OVER (PARTITION BY user_id, island ORDER BY event_id) AS BIGINT) AS streak FROM i), f AS (SELECT user_id, min(event_id) FILTER (streak >= 3) AS stop FROM s GROUP BY user_id)
SELECT event_id, novel, streak FROM s JOIN f USING (user_id) WHERE stop IS NULL OR event_id <= stop""",
    "watchdog_flags": "SELECT event_id, stalled, CAST(n AS BIGINT) AS stalls, n >= 2 AS terminal FROM (SELECT *, sum(stalled::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM (SELECT event_id, user_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) > 240000000, false) AS stalled FROM events))",
    "unanimous_votes": f"SELECT conv_id, bool_and(NOT contains(text, '?')) AND sum({_LINKS}) = 0 AS stop, arg_max(md5(text), turn) FILTER (role = 'assistant') AS reason FROM conversations GROUP BY conv_id",
    "events_by_url": "SELECT user_id, coalesce(json_extract_string(props, '$.url'), json_extract_string(props, '$.from_url'), 'general') AS url, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY ALL",
    "key_with_variants": "WITH s AS (SELECT c_custkey, lower(c_mktsegment) || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '::' || c_nationkey END AS name_key FROM customer), k AS (SELECT DISTINCT lower(c_mktsegment) AS key FROM customer WHERE c_custkey < 3) SELECT DISTINCT c_custkey, name_key FROM s JOIN k ON name_key = key OR starts_with(name_key, key || '::')",
    "relaxed_targets": f"""WITH p AS (SELECT page_id, {_SITE} AS site, {_YEAR_LIST.format(x='url')} AS u, {_YEAR_LIST.format(x=_TITLE)} AS t, {_YEAR_LIST.format(x='html')} AS y FROM pages),
q AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN site WHEN page_id % 2 = 0 THEN 'Known' END AS name, coalesce(u[-1], t[-1], y[-1], CASE WHEN page_id % 2 = 0 THEN 2021 END) AS year, greatest(0.35, least(0.8, CASE WHEN page_id % 10 = 0 THEN 0.55 ELSE page_id % 10 / 10.0 END))::DOUBLE AS confidence FROM p)
SELECT *, 'relaxed_context_fallback' AS reason FROM q WHERE name IS NOT NULL AND year IS NOT NULL""",
    "linkable_records": f"SELECT doc_id, {_ANY("lower(coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN ' session chair ' ELSE '  ' END || coalesce(source, ''))", K.PERSON_HINTS)} OR doc_id % 7 = 0 OR (trim(coalesce(source, '')) <> '' AND doc_id % 10 / 10.0 >= 0.6) AS linkable FROM documents",
    "nav_noise_blocks": f"SELECT page_id, {_ANY('lower(html)', K.NAV_NOISE)} AND NOT regexp_matches(html, '{_Q(K.BLOCK_CREDENTIAL)}') AND NOT regexp_matches(html, '{K.TIME_MARKER}') AS noise FROM pages",
    "expand_decisions": f"""SELECT page_id, reason = 'low_yield_dynamic_page' AS attempt, reason FROM (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'already_attempted' WHEN page_id % 3 = 1 THEN 'intent_archive_not_targeted' WHEN NOT {_ANY("lower(url || ' ' || html)", [_Q(x) for x in K.DYNAMIC_HINTS])} THEN 'no_dynamic_signal' WHEN page_id % 5 >= 3 THEN 'baseline_yield_sufficient' ELSE 'low_yield_dynamic_page' END AS reason FROM pages)""",
    "prioritised_blocks": "SELECT conv_id, turn, CAST(p AS INTEGER) AS priority FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY p DESC, turn) AS rn FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS p FROM conversations)) WHERE rn <= CASE WHEN conv_id % 8 >= 6 THEN 8 WHEN conv_id % 8 >= 3 THEN 12 ELSE 20 END",
}
