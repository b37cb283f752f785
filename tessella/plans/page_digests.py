"""Queries of links and packets of pages, fetch outcomes, gates and client-side views, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import dom, fetch
from ..functions import html as H
from ..functions import text as T
from ..functions import url as U
from ..operators import dedupe, fallback, navigation
from ..session import checkpointed
from .marts import read
from .oracles import _HOST, _LIST, _LOOSE, _PATH, _SITE, _TITLE, _WS, _YEAR_LIST
from .oracles import ORACLES as _CORE
from .page_trees import _BLOCKS, _plain


def nav_links(s: SparkSession, d: str) -> DataFrame:
    """Links as navigation sees them: without a text, the last part of the path stands for it."""
    rows = navigation.internal_links(read(s, d, "pages").select("page_id", "url", "html"))
    shown = F.when(F.length("url") % 3 == 0, "").otherwise(F.col("anchor"))  # every third one as an image link
    return navigation.nav_rows(rows.withColumn("text", shown)).select("page_id", "pos", "url", "text", "context")


def seed_packets(s: SparkSession, d: str) -> DataFrame:
    p = navigation.seed_packets(read(s, d, "pages").select("page_id", "url", "html"))
    return p.select("page_id", "domain", "title", F.md5(F.col("visible_text").cast("binary")).alias("visible"), F.size("links").alias("links"), F.array_join(F.col("year_hints").cast("array<string>"), ",").alias("years"))


def fetch_outcomes(s: SparkSession, d: str) -> DataFrame:
    """Pages as crawled first (thin, failed or empty for some) and fetched again with their document's text."""
    p = read(s, d, "pages").join(read(s, d, "documents").select(F.col("doc_id").alias("page_id"), "text"), "page_id", "left").select("page_id", "url", F.col("text").alias("doc"), "html")
    side = lambda text, links: F.struct(F.when(F.col("page_id") % 11 == 0, "pdf").otherwise("html").alias("kind"), text.alias("text"), links.alias("links"), F.lit(0).alias("pdf_links"))
    first = F.when(F.col("page_id") % 5 != 1, side(F.substring("doc", 1, 900), F.when(F.col("page_id") % 3 == 0, 2).otherwise(0)))
    second = F.when(F.col("page_id") % 7 != 2, side(F.col("html"), F.lit(1)))
    seed = F.when(F.col("page_id") % 13 == 5, "https://elsewhere.invalid/").otherwise(F.col("url"))
    o = fetch.crawl_outcome(seed, F.col("url"), F.col("page_id") % 6 != 4, first, F.when(F.col("page_id") % 10 == 1, "timeout"), second)
    return p.select("page_id", o.alias("o")).select("page_id", "o.status", "o.reason", "o.used_fallback", F.length("o.text").cast("long").alias("n"))


def interaction_gate(s: SparkSession, d: str) -> DataFrame:
    t = dom.parsed(read(s, d, "pages").select("page_id", "url", "html"))
    links, blocks = F.size(dom.links()), F.size(dom.blocks(None))
    gate = fetch.explores_interactions(F.col("page_id") % 8 != 7, (F.col("page_id") % 6).cast("int"), 4, U.content_type(F.lit(None).cast("string"), F.col("url")), links, blocks, (F.col("page_id") % 5).cast("int"), 6, 6)
    return t.select("page_id", gate.alias("explore"))


def model_routing(s: SparkSession, d: str) -> DataFrame:
    stage = F.element_at(F.array(*[F.lit(x) for x in [*K.MODEL_STAGES, "default"]]), (F.col("event_id") % 9 + 1).cast("int"))
    model = fetch.model_choice(stage, ["preflight", "triage", "navigation"], " reasoner ", "chat")
    e = read(s, d, "events").select("event_id", stage.alias("stage"), model.alias("model"), "value")
    return e.select("event_id", "stage", "model", fetch.timeout_choice(F.col("model"), "reasoner", F.col("value"), 30.0).alias("seconds"))


def work_saved(s: SparkSession, d: str) -> DataFrame:
    """Batches of texts (by source and language) as work: the first one of a key is done, the others are spared."""
    docs = read(s, d, "documents").select("doc_id", "source", "lang", F.sha2(F.substring("text", 1, 1).cast("binary"), 256).alias("h"))
    batch = docs.groupBy("source", "lang").agg(F.min("doc_id").alias("first_doc"), F.collect_set("h").alias("hashes"))
    keyed = batch.select("source", "lang", "first_doc", fetch.work_key("v3", F.col("hashes")).alias("key"))
    return dedupe.seen_before(keyed, F.col("key"), [F.col("first_doc")]).select("source", "lang", "key", F.col("seen").alias("spared"))


def client_sessions(s: SparkSession, d: str) -> DataFrame:
    """A person's sessions as a client lists them: those with a title, the first of equal title, role and year."""
    o = read(s, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("session"), F.col("o_orderstatus").alias("role"), F.year("o_orderdate").alias("year"))
    return dedupe.first_by(o.where("coalesce(session, '') != ''"), ["o_custkey", "session", "role", "year"], [F.col("o_orderkey")]).select("o_orderkey", "o_custkey", "session", "role", "year")


def last_events(s: SparkSession, d: str) -> DataFrame:
    """The newest 80 events of each run, newest first."""
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return read(s, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("place")).where("place <= 80")


def allowed_links(s: SparkSession, d: str) -> DataFrame:
    """Proposed links that the page really has; proposals are the links of the page before, canonical."""
    links = navigation.link_targets(read(s, d, "pages").select("page_id", "url", "html"))
    wanted = links.select((F.col("page_id") + F.when(F.col("page_id") % 2 == 0, 0).otherwise(1)).alias("page_id"), "url")
    return wanted.join(links, ["page_id", "url"], "left_semi")


def batch_results(s: SparkSession, d: str) -> DataFrame:
    """Records with the result of their index in the batch, if there is one, else their defaults."""
    o = read(s, d, "orders").select("o_orderkey", "o_custkey", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("index"))
    e = read(s, d, "events").groupBy((F.col("user_id") % 50).alias("batch"), (F.col("event_id") % 4).alias("index")).agg(F.max("value").alias("score"))
    joined = o.join(e, (o.o_custkey == e.batch) & (o["index"] == e["index"]), "left")
    return joined.select("o_orderkey", o["index"], F.coalesce("score", F.lit(0.0)).alias("score"), F.when(F.col("score").isNull(), "attribution_reconcile_no_targets").alias("reason"))


def branch_ends(s: SparkSession, d: str) -> DataFrame:
    """How a page's navigation ends: links that pass the filter, else those of a second try with a wider focus."""
    p = read(s, d, "pages").select("page_id", "url", "html")
    rows = navigation.internal_links(p).withColumnRenamed("anchor", "text").join(p.select("page_id", F.col("url").alias("page")), "page_id")
    kept = lambda words: navigation.filter_links(rows.withColumn("seed", F.col("page")), "seed", "page", F.array(*[F.lit(w) for w in words]), F.lit(True), ["page_id"], "pos").groupBy("page_id").agg(F.count_if("kept").alias("n"))
    both = kept(["the"]).withColumnRenamed("n", "first").join(kept(["the", "and", "les", "und", "les"]).withColumnRenamed("n", "again"), "page_id")
    return both.select("page_id", "first", "again", fetch.branch_end(F.col("first"), F.col("again")).alias("nav_source"))


def event_ages(s: SparkSession, d: str) -> DataFrame:
    """Days from each event to the newest one of its run."""
    e = read(s, d, "events").select("event_id", "user_id", "ts")
    newest = e.groupBy("user_id").agg(F.max("ts").alias("now"))
    return e.join(newest, "user_id").select("event_id", F.round(fetch.age_days(F.col("ts"), F.col("now")), 6).alias("days"))


def nav_fallback(s: SparkSession, d: str) -> DataFrame:
    """The eight next addresses of each page without a model: all its links and documents, scored by its own words; the root of its site is the seed."""
    p = read(s, d, "pages").select("page_id", F.col("url").alias("page"), "html")
    told = dom.parsed(p.withColumns({"title": H.title(F.col("html")), "heads": H.headings(F.col("html"))}))
    seed = F.concat(U.scheme(F.col("page")), F.lit("://"), U.host(F.col("page")), F.lit("/"))
    words = fallback.focus_tokens(seed, F.col("page"), F.col("title"), F.col("heads"), dom.main_content())
    # Words and links of a page come from one parse, which is kept: links, visited ones and both readings of the pool would repeat it.
    told = checkpointed(told.select("page_id", "page", seed.alias("seed"), words.alias("focus"), navigation.resolved_links(F.col("page")).alias("found")))
    own = navigation.own_links(told.select("page_id", F.col("page").alias("base"), "found"), F.col("found"))
    links = own.select("page_id", "pos", "url", F.col("anchor").alias("text"), F.when(F.col("pos") % 3 == 0, "link").otherwise("html_anchor").alias("context"), U.is_pdf_like(F.col("url")).alias("pdf"))
    visited = links.where("pos % 7 = 6").select("page_id", "url")
    return fallback.select(fallback.pool(links.join(told.drop("found"), "page_id"), visited), 8)


QUERIES = {f.__name__: f for f in (nav_fallback, nav_links, seed_packets, fetch_outcomes, interaction_gate, model_routing, work_saved, client_sessions, last_events, allowed_links, batch_results, branch_ends, event_ages)}

_LINKS = _CORE["internal_links"]


def _words(x: str) -> str:
    """Navigation words of a text, singulars beside them."""
    good = f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) >= 3 AND NOT regexp_full_match(t, '[0-9]+') AND NOT list_contains({_LIST(K.NAV_IGNORE)}, t))"
    return f"list_concat({good}, list_transform(list_filter({good}, lambda t: ends_with(t, 's') AND length(t) > 4), lambda t: left(t, length(t) - 1)))"


def _first_part(url: str) -> str:
    return f"coalesce(lower(list_filter(string_split({_PATH.replace('(url,', f'({url},')}, '/'), lambda s: s <> '')[1]), '')"


def _in_scope(words: str, text: str, focus: str) -> str:
    """Whether (url, seed, page) is in scope, on one site."""
    signal, focused = f"list_has_any({words}, {_LIST(K.NAV_SIGNAL)})", f"list_has_any({words}, {focus})"
    dated = f"len({_YEAR_LIST.format(x=f'(url || {chr(39)} {chr(39)} || {text})')}) > 0 AND {_first_part('seed')} <> '' AND {_first_part('seed')} = {_first_part('url')}"
    return f"NOT (list_has_any({words}, {_LIST(K.NAV_EXCLUDE)}) AND NOT {signal}) AND NOT (lower(trim({text})) IN ({', '.join(repr(g) for g in K.GENERIC_ANCHORS)}) AND NOT {focused}) AND ({focused} OR {dated} OR {signal})"


_ALL_LINKS = _LINKS.replace("<= 60", "<= 1000000000")

_GATE = _LOOSE.format(x="url || CASE WHEN page_id % 9 = 0 THEN ' program' ELSE '' END", ws=_WS)
_META = lambda attribute, name: f"nullif(trim(regexp_replace(regexp_extract(html, '(?is)<meta[^>]*{attribute}=[\"'']{name}[\"''][^>]*content=[\"'']([^\"'']*)[\"'']', 1), '\\s+', ' ', 'g')), '')"
_CANDIDATES = f"""
p AS (SELECT page_id, url, {_SITE} AS site, canonical, first_value(url) OVER (PARTITION BY {_SITE} ORDER BY page_id) AS seed,
      CASE page_id % 4 WHEN 0 THEN 'non_content' WHEN 1 THEN 'listing' ELSE 'unknown' END AS kind, trim(CASE page_id % 3 WHEN 0 THEN 'speakers of the day' WHEN 1 THEN 'plain words' ELSE '' END || ' /hint') AS text FROM pages JOIN ({_CORE['url_canonical']}) USING (page_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY site, canonical ORDER BY page_id) AS nth, {_words("url || ' ' || text || ' ' || kind")} AS every, {_words(_PATH + " || ' ' || text")} AS own FROM p)"""

ORACLES = {
    "gatekeeper_split": f"WITH m AS (SELECT page_id, {_SITE} AS site, page_id % 10 >= 6 AND list_has_any({_GATE}, {_LIST(K.GATEKEEPER)}) AS g FROM pages) SELECT page_id, g OR (NOT bool_or(g) OVER (PARTITION BY site) AND row_number() OVER (PARTITION BY site ORDER BY page_id) = 1) AS gatekeeper FROM m",
    "years_in_pages": f"SELECT page_id, array_to_string({_YEAR_LIST.format(x='t')}, ',') AS years FROM (SELECT page_id, url || ' ' || {_plain('html')} AS t FROM pages)",
    "site_names": f"SELECT page_id, coalesce({_META('property', 'og:site_name')}, {_META('name', 'application-name')}, {_META('name', 'apple-mobile-web-app-title')}) AS site_name FROM pages",
    "interaction_gate": f"{_BLOCKS}, c AS (SELECT page_id, count(*) AS n FROM blocks GROUP BY page_id) SELECT p.page_id, p.page_id % 8 <> 7 AND p.page_id % 6 < 4 AND NOT ends_with(lower(url), '.pdf') AND (len(regexp_extract_all(html, '<a href=\"[^\"]+\"')) < 6 OR coalesce(n, 0) = 0 OR p.page_id % 5 >= 3) AS explore FROM pages p LEFT JOIN c ON c.page_id = p.page_id",
    "candidate_links": f"""WITH {_CANDIDATES}, w AS (SELECT page_id, CASE WHEN nth > 1 THEN 'repeated' WHEN page_id % 2 = 1 AND (contains(lower(url), 'pdf') OR contains(lower(url), 'brochure')) THEN 'pdf' WHEN kind = 'non_content' THEN 'no_content'
WHEN kind = 'unknown' AND NOT list_has_any(every, {_LIST([*K.NAV_SIGNAL, 'plain'])}) THEN 'no_signal' WHEN {_in_scope('own', 'text', "['plain']")} THEN 'kept' ELSE 'out_of_scope' END AS why FROM n)
SELECT page_id, why = 'kept' AS kept, why FROM w""",
    "branch_ends": f"""WITH l AS (SELECT l.page_id, l.url, l.anchor AS text, p.url AS seed, row_number() OVER (PARTITION BY l.page_id, CASE WHEN ends_with(l.url, '/') THEN l.url[:-2] ELSE l.url END ORDER BY pos) AS nth FROM ({_LINKS}) l JOIN pages p ON l.page_id = p.page_id),
w AS (SELECT *, {_words(_PATH + " || ' ' || text")} AS own FROM l),
n AS (SELECT page_id, count(*) FILTER (nth = 1 AND {_in_scope('own', 'text', "['the']")}) AS first, count(*) FILTER (nth = 1 AND {_in_scope('own', 'text', "['the', 'and', 'les', 'und']")}) AS again FROM w GROUP BY page_id)
SELECT page_id, first, again, CASE WHEN first > 0 THEN 'pathfinder' WHEN again > 0 THEN 'nav_reask' ELSE 'branch_closed_no_links' END AS nav_source FROM n""",
    "filtered_links": f"""WITH l AS (SELECT l.page_id, pos, l.url, l.anchor AS text, p.url AS seed, {_words(_PATH.replace('(url,', '(p.url,') + " || ' ' || " + _TITLE)} AS focus, row_number() OVER (PARTITION BY l.page_id, CASE WHEN ends_with(l.url, '/') THEN l.url[:-2] ELSE l.url END ORDER BY pos) AS nth FROM ({_LINKS}) l JOIN pages p ON l.page_id = p.page_id),
w AS (SELECT *, {_words(_PATH + " || ' ' || text")} AS own FROM l)
SELECT page_id, pos, url, CASE WHEN nth > 1 THEN 'repeated' WHEN contains(lower(url), 'pdf') OR contains(lower(url), 'brochure') THEN 'pdf' WHEN {_in_scope('own', 'text', 'focus')} THEN 'kept' ELSE 'out_of_scope' END AS why FROM w""",
    "nav_links": f"SELECT page_id, pos, url, left(CASE WHEN length(url) % 3 = 0 OR anchor = '' THEN left(string_split(trim(regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1), '/'), '/')[-1], 120) ELSE anchor END, 220) AS text, 'link' AS context FROM ({_LINKS})",
    "seed_packets": f"SELECT p.page_id, {_HOST} AS domain, {_TITLE.replace('regexp_extract', 'regexp_extract')} AS title, md5(left({_plain('html')}, 2000)) AS visible, CAST(least(30, (SELECT count(*) FROM ({_LINKS}) l WHERE l.page_id = p.page_id)) AS INTEGER) AS links, array_to_string({_YEAR_LIST.format(x=_TITLE + " || ' ' || left(" + _plain('html') + ', 2000)')}[1:12], ',') AS years FROM pages p",
    "fetch_outcomes": """WITH p AS (SELECT page_id, left(text, 900) AS t, html, page_id % 5 <> 1 AS f, page_id % 7 <> 2 AS g FROM pages LEFT JOIN documents ON doc_id = page_id),
r AS (SELECT *, CASE WHEN page_id % 13 = 5 THEN 'out_of_domain' WHEN page_id % 6 = 4 THEN 'crawl4ai_disabled' WHEN f AND CASE WHEN page_id % 11 = 0 THEN length(trim(t)) >= 40 ELSE length(trim(t)) >= 300 OR page_id % 3 = 0 END THEN NULL WHEN f THEN 'crawl4ai_thin_content' WHEN page_id % 10 = 1 THEN 'timeout' ELSE 'crawl4ai_failed' END AS reason FROM p)
SELECT page_id, CASE WHEN reason IS NULL OR reason <> 'out_of_domain' AND g THEN 'fetched' ELSE 'error' END AS status, reason, reason IS NOT NULL AND reason <> 'out_of_domain' AS used_fallback, coalesce(CASE WHEN reason IS NULL THEN length(t) WHEN reason <> 'out_of_domain' AND g THEN length(html) END, 0) AS n FROM r""",
    "model_routing": f"SELECT event_id, stage, model, CASE WHEN model = 'reasoner' THEN greatest(value, 30.0) ELSE value END AS seconds FROM (SELECT event_id, value, stage, CASE WHEN stage IN ('preflight', 'triage', 'navigation') THEN 'reasoner' ELSE 'chat' END AS model FROM (SELECT *, {_LIST([*K.MODEL_STAGES, 'default'])}[event_id % 9 + 1] AS stage FROM events))",
    "work_saved": "WITH b AS (SELECT source, lang, min(doc_id) AS f, sha256('v3::' || string_agg(DISTINCT sha256(left(text, 1)), '||' ORDER BY sha256(left(text, 1)))) AS key FROM documents GROUP BY source, lang) SELECT source, lang, key, row_number() OVER (PARTITION BY key ORDER BY f) > 1 AS spared FROM b",
    "client_sessions": "SELECT min(o_orderkey) AS o_orderkey, o_custkey, o_orderpriority AS session, o_orderstatus AS role, year(o_orderdate) AS year FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderpriority <> '' GROUP BY ALL",
    "last_events": "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS INTEGER) AS place FROM events QUALIFY place <= 80",
    "allowed_links": f"WITH l AS (SELECT DISTINCT page_id, CASE WHEN ends_with(url, '/') THEN url[:-2] ELSE url END AS url FROM ({_ALL_LINKS})) SELECT DISTINCT b.page_id, b.url FROM l a JOIN l b ON a.url = b.url AND b.page_id = a.page_id + a.page_id % 2",
    "batch_results": "WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders), e AS (SELECT user_id % 50 AS b, event_id % 4 AS i, max(value) AS score FROM events GROUP BY ALL) SELECT o_orderkey, o.i AS index, coalesce(score, 0.0) AS score, CASE WHEN score IS NULL THEN 'attribution_reconcile_no_targets' END AS reason FROM o LEFT JOIN e ON o_custkey = b AND o.i = e.i",
    "event_ages": "SELECT event_id, round(date_diff('microsecond', ts, max(ts) OVER (PARTITION BY user_id)) / 8.64e10, 6) AS days FROM events",
}
