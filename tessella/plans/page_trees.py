"""Queries over element trees of pages and over lines of texts, with their DuckDB SQL.

The SQL reads the pages by regular expressions that hold for their shape (one
article, one navigation list, one footer, paragraphs that end at the next one); it
shares no code with the tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import dom
from ..functions import html as H
from ..functions import text as T
from ..functions import url as U
from . import marts
from .marts import read
from .oracles import _ANY, _LIST, _LOOSE, _TITLE, _WS


def _trees(s: SparkSession, d: str) -> DataFrame:
    return dom.parsed(read(s, d, "pages").select("page_id", "html"))


def _sha(x):
    return F.sha2(x.cast("binary"), 256)


def page_elements(s: SparkSession, d: str) -> DataFrame:
    """Elements of each page by tag, and how many of them have element children."""
    e = _trees(s, d).select("page_id", F.explode("elements").alias("e"))
    return e.groupBy("page_id", F.col("e.tag").alias("tag")).agg(F.count("*").alias("n"), F.count_if(F.col("e.last") > F.col("e.id")).alias("parents"))


def page_paths(s: SparkSession, d: str) -> DataFrame:
    """Items of a page by whether they stand in its frame, and the elements right under its article."""
    t = _trees(s, d)
    article = F.get(F.filter("elements", lambda e: e["tag"] == "article"), F.lit(0))["id"]
    items = F.filter("elements", lambda e: e["tag"] == "li")
    return t.select("page_id", F.size(F.filter(items, lambda e: e["framed"])).alias("framed_items"), F.size(F.filter(items, lambda e: ~e["framed"])).alias("items"), F.size(F.filter("elements", lambda e: e["parent"] == article)).alias("in_article"))


def visible_text(s: SparkSession, d: str) -> DataFrame:
    return _trees(s, d).select("page_id", F.length("text").cast("long").alias("n"), _sha(F.col("text")).alias("sha"))


def main_content(s: SparkSession, d: str) -> DataFrame:
    t = _trees(s, d).select("page_id", dom.main_content().alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("n"), _sha(F.col("t")).alias("sha"))


def event_text(s: SparkSession, d: str) -> DataFrame:
    return _trees(s, d).select("page_id", _sha(dom.event_text(None)).alias("sha"))


def text_blocks(s: SparkSession, d: str) -> DataFrame:
    b = _trees(s, d).select("page_id", F.posexplode(dom.blocks(None)).alias("pos", "block"))
    return b.select("page_id", "pos", F.md5(F.col("block").cast("binary")).alias("md5"))


def line_shapes(s: SparkSession, d: str) -> DataFrame:
    """How many lines of a document have the shape of a session title and of a person's name, titles and first names cut apart."""
    lines = F.filter(F.split("text", "\n"), lambda x: T.collapse(x) != "")
    starts = F.transform(lines, lambda x: F.array_join(F.slice(F.split(T.collapse(x), " "), 1, 2), " "))
    return read(s, d, "documents").select("doc_id", F.size(F.filter(lines, T.is_session_title)).alias("titles"), F.size(F.filter(starts, T.is_person_name)).alias("names"))


def sanitize_lines(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", _sha(T.sanitize_lines(F.col("text"))).alias("sha"))


def person_like_whole(s: SparkSession, d: str) -> DataFrame:
    return _trees(s, d).select("page_id", T.person_like(F.col("text")).alias("hit"))


def page_intent_whole(s: SparkSession, d: str) -> DataFrame:
    """Intent of pages by address, title and the whole main content."""
    p = dom.parsed(read(s, d, "pages").withColumn("title", H.title(F.col("html"))))
    return p.select("page_id", T.page_intent(F.col("url"), F.col("title"), dom.main_content(), U.content_type(F.lit(None).cast("string"), F.col("url"))).alias("intent"))


def artifact_unpivot_whole(s: SparkSession, d: str) -> DataFrame:
    """The five kinds of artifacts of a page, where it has them."""
    p = dom.parsed(read(s, d, "pages").withColumn("title", H.title(F.col("html"))))
    found = F.transform(dom.blocks(None), lambda b: F.struct(b.alias("block")))
    asked = F.parse_url("url", F.lit("QUERY"))
    kinds = {
        "clean_text": F.col("text"),
        "pdf_text": F.when(U.is_pdf_like(F.col("url")), dom.main_content()),
        "network_json_sample": F.when(asked != "", F.to_json(F.struct(asked.alias("query")))),
        "candidate_blocks": F.when(F.size(found) > 0, F.to_json(found)),
        "llm_output": F.when(F.col("title") != "", F.to_json(F.struct(F.array(F.struct(F.col("title").alias("session"))).alias("records")))),
    }
    return marts.artifacts(p, "page_id", kinds).select("page_id", "artifact", F.md5(F.col("data").cast("binary")).alias("md5"))


QUERIES = {f.__name__: f for f in (page_elements, page_paths, visible_text, main_content, event_text, text_blocks, line_shapes, sanitize_lines, person_like_whole, page_intent_whole, artifact_unpivot_whole)}


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _bare(x: str) -> str:
    """Without comments, scripts and styles."""
    return rf"regexp_replace(regexp_replace({x}, '(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"


def _plain(x: str) -> str:
    """Text of html: tags to blanks, the entities that pages use to characters."""
    return _squeeze(rf"regexp_replace(replace(replace(replace(regexp_replace({_bare(x)}, '<[^>]*>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '&amp;?', '&', 'g')")


_ARTICLE = "regexp_extract(html, '(?s)<article>(.*)</article>', 1)"
_FRAMELESS = "regexp_replace(regexp_replace(html, '(?s)<nav>.*?</nav>', ' ', 'g'), '(?s)<footer>.*?</footer>', ' ', 'g')"
_MAIN = f"(SELECT page_id, CASE WHEN length(a) >= 300 THEN a ELSE f END AS t, a, html FROM (SELECT page_id, html, {_plain(_ARTICLE)} AS a, {_plain(_FRAMELESS)} AS f FROM pages))"
_CUES = "(?i)" + "|".join([*K.SPEAKER_HINTS, *K.SESSION_HINTS, ", md", ", do", ", od"])
_STRIPPED = lambda parts, ends: f"list_transform({parts}, lambda p: trim(lower(p), '{ends}'))"
_CALM = "coalesce(list_position(list_transform({p}, lambda w: upper(w) = w AND lower(w) <> w), false), len({p}) + 1)"


def _person(line: str) -> str:
    """Whether a squeezed line has the shape of a name; two words at least are left when capital words are cut."""
    p = f"string_split({line}, ' ')"
    cut = f"list_slice({p}, CAST(1 + least({_CALM.format(p=p)} - 1, greatest(len({p}) - 2, 0)) AS BIGINT), len({p}))"
    low = _STRIPPED(cut, ".")
    odd = f"len(list_filter({low}, lambda w: list_contains({_LIST(K.NON_NAME)}, w)))"
    return f"(regexp_matches(array_to_string({cut}, ' '), '{_quoted(K.PERSON_NAME)}') AND len({cut}) BETWEEN 2 AND 5 AND len(list_distinct({low})) > 1 AND {odd} < CASE WHEN len({cut}) = 2 THEN 1 ELSE 2 END)"


def _session(line: str) -> str:
    low = _STRIPPED(f"string_split({line}, ' ')", ".:")
    return f"(length({line}) >= 16 AND len({low}) >= 3 AND len(list_distinct({low})) > 1 AND len(list_filter({low}, lambda w: list_contains({_LIST(K.NON_SESSION)}, w))) < 2 AND (regexp_matches({line}, '{K.SESSION_WORD}') OR len({low}) >= 4))"


def _sanitized(lines: str) -> str:
    """(key, t) from lines (key, i, line): boilerplate dropped, joined, addresses cut out."""
    noise = "|".join(K.CONTEXT_NOISE)
    keep = f"line <> '' AND NOT starts_with(lower(line), 'copyright') AND NOT contains(lower(line), 'all rights reserved') AND NOT regexp_matches(line, '{K.ASSET_YEAR_URL}') AND NOT regexp_full_match(line, '{K.URL_TOKEN}') AND (NOT regexp_matches(lower(line), '{noise}') OR regexp_matches(line, '{K.SESSION_WORD}') OR regexp_matches(line, '{_quoted(K.BLOCK_CREDENTIAL)}') OR {_person('line')})"
    joined = f"regexp_replace(coalesce(string_agg(CASE WHEN {keep} THEN line END, ' ' ORDER BY i), ''), '{K.URL_TOKEN}', ' ', 'g')"
    return f"SELECT key, {_squeeze(joined)} AS t FROM ({lines}) GROUP BY key"


_DOC_LINES = rf"SELECT doc_id AS key, i, {_squeeze('line')} AS line FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(replace(text, chr(13), chr(10)), '\n+') AS x FROM documents))"

_BLOCKS = rf"""
WITH m AS (SELECT page_id, a, html, length(a) >= 25 AND regexp_matches(a, '{_CUES}') AND NOT regexp_matches(lower(a), '{"|".join(K.NAV_NOISE)}') AS hit FROM {_MAIN}),
p AS (SELECT page_id, i, {_plain('x')} AS t FROM (SELECT page_id, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM (SELECT page_id, list_transform(string_split({_ARTICLE}, '<p>')[2:], lambda q: string_split(q, '</p>')[1]) AS x FROM m WHERE NOT (hit AND length(a) <= 1600)))),
b AS (SELECT page_id, 0 AS i, '[BLOCK dom_card]' || chr(10) || a AS block FROM m WHERE hit AND length(a) <= 1600
      UNION ALL SELECT page_id, min(i), '[BLOCK paragraph]' || chr(10) || t FROM p WHERE length(t) >= 60 GROUP BY page_id, t),
blocks AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos, block FROM b)"""
_INTENT = _LOOSE.format(x=f"url || ' ' || {_TITLE} || ' ' || t", ws=_WS)
_PDF = _ANY("lower(url)", ["pdf", "brochure"])

ORACLES = {
    "page_elements": rf"""
WITH e AS (SELECT page_id, lower(unnest(regexp_extract_all({_bare('html')} , '<([A-Za-z][A-Za-z0-9]*)', 1))) AS tag FROM pages
           UNION ALL SELECT page_id, unnest(['script', 'style']) AS tag FROM pages)
SELECT page_id, tag, count(*) AS n,
       CASE WHEN tag IN ('html', 'head', 'body', 'nav', 'ul', 'article') THEN count(*) WHEN tag = 'li' THEN count(*)
            WHEN tag = 'p' THEN (SELECT len(regexp_extract_all(html, '<p><b>')) FROM pages q WHERE q.page_id = e.page_id)
            WHEN tag = 'b' THEN (SELECT len(regexp_extract_all(html, '<b>[^<]*<br>')) FROM pages q WHERE q.page_id = e.page_id) ELSE 0 END AS parents
FROM e GROUP BY page_id, tag""",
    "page_paths": "SELECT page_id, CAST(len(regexp_extract_all(html, '<li>')) AS INTEGER) AS framed_items, 0 AS items, CAST(len(regexp_extract_all(html, '<(?:h1|p)>')) AS INTEGER) AS in_article FROM pages",
    "visible_text": f"SELECT page_id, length(t) AS n, sha256(t) AS sha FROM (SELECT page_id, {_plain('html')} AS t FROM pages)",
    "main_content": f"SELECT page_id, length(t) AS n, sha256(t) AS sha FROM {_MAIN}",
    "event_text": f"SELECT key AS page_id, sha256(t) AS sha FROM ({_sanitized(f'SELECT page_id AS key, 1 AS i, t AS line FROM {_MAIN}')})",
    "text_blocks": f"{_BLOCKS} SELECT page_id, pos, md5(block) AS md5 FROM blocks",
    "line_shapes": f"SELECT key AS doc_id, CAST(count(*) FILTER (line <> '' AND {_session('line')}) AS INTEGER) AS titles, CAST(count(*) FILTER (line <> '' AND {_person('two')}) AS INTEGER) AS names FROM (SELECT *, array_to_string(string_split(line, ' ')[1:2], ' ') AS two FROM ({_DOC_LINES})) GROUP BY key",
    "sanitize_lines": f"SELECT key AS doc_id, sha256(t) AS sha FROM ({_sanitized(_DOC_LINES)})",
    "person_like_whole": f"SELECT page_id, {_ANY('lower(t)', K.PERSON_HINTS)} AS hit FROM (SELECT page_id, {_plain('html')} AS t FROM pages)",
    "page_intent_whole": f"SELECT page_id, CASE WHEN ends_with(lower(url), '.pdf') THEN 'pdf' WHEN list_has_any(w, {_LIST(K.ARCHIVE)}) THEN 'archive' WHEN list_has_any(w, {_LIST(K.GATEKEEPER)}) THEN CASE WHEN list_has_any(w, ['session', 'plenary']) THEN 'session_detail' ELSE 'gatekeeper' END WHEN list_has_any(w, {_LIST(K.UTILITY)}) THEN 'non_content' ELSE 'listing' END AS intent FROM (SELECT page_id, url, {_INTENT} AS w FROM {_MAIN} JOIN (SELECT page_id, url FROM pages) USING (page_id))",
    "artifact_unpivot_whole": rf"""{_BLOCKS}
SELECT page_id, artifact, md5(data) AS md5 FROM (
SELECT page_id, 'clean_text' AS artifact, {_plain('html')} AS data FROM pages
UNION ALL SELECT page_id, 'pdf_text', t FROM {_MAIN} JOIN (SELECT page_id, url FROM pages) USING (page_id) WHERE {_PDF}
UNION ALL SELECT page_id, 'network_json_sample', CAST(to_json({{'query': q}}) AS VARCHAR) FROM (SELECT page_id, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages) WHERE q <> ''
UNION ALL SELECT page_id, 'candidate_blocks', CAST(to_json(list({{'block': block}} ORDER BY pos)) AS VARCHAR) FROM blocks GROUP BY page_id
UNION ALL SELECT page_id, 'llm_output', CAST(to_json({{'records': [{{'session': {_TITLE}}}]}}) AS VARCHAR) FROM pages WHERE {_TITLE} <> '') WHERE data <> ''""",
}
