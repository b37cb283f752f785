"""Independent DuckDB SQL for the catalogue's queries."""

from __future__ import annotations

from ..functions import constants as K

_APP = "(SELECT o.*, c.c_name, n.n_name, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders o JOIN customer c ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey)"
_K = "greatest(0, coalesce(TRY_CAST(json_extract(props, '$.k') AS INTEGER), 0))"
_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1))"
_SCHEME = r"lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1))"
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)"
_QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
_SEGS = f"list_filter(string_split({_PATH}, '/'), lambda s: s <> '')"
_LABELS = f"list_filter(string_split({_HOST}, '.'), lambda s: s <> '')"
_SITE = f"array_to_string({_LABELS}[greatest(1, len({_LABELS}) - 1):], '.')"
_TRIM = lambda p: f"CASE WHEN {p} = '' THEN '/' WHEN {p} <> '/' THEN regexp_replace({p}, '/$', '') ELSE {p} END"
_NOSLASH = f"regexp_replace({_PATH}, '/{{2,}}', '/', 'g')"
_TPL = "'/' || array_to_string(list_transform({s}, lambda s: CASE WHEN regexp_matches(lower(s), '^[0-9]+$') THEN '{{num}}' WHEN regexp_matches(lower(s), '{hex}') THEN '{{id}}' ELSE lower(s) END), '/')"
_FULL = _TPL.format(s=_SEGS, hex="^[0-9a-f]{10,}$")
_ANY = lambda text, terms: "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_WS = r"'[ \t\n\x0B\f\r]+'"
_CAT = f"CASE WHEN contains(lower(url), 'pdf') THEN 'pdf_program' WHEN {_ANY('lower(url)', K.SPEAKER_TERMS)} THEN 'official_speakers' WHEN {_ANY('lower(url)', K.PROGRAM_TERMS)} THEN 'official_program' WHEN {_ANY('lower(url)', K.PLATFORM_CATEGORY)} THEN 'platform' ELSE 'unknown' END"
_NAV = f"list_filter(regexp_extract_all(lower(url), '[a-z0-9]+'), lambda t: length(t) >= 3 AND NOT regexp_matches(t, '^[0-9]+$') AND NOT list_contains({_LIST(K.NAV_IGNORE)}, t))"
_STREAK = """SELECT event_id, CAST(sum(CASE WHEN {hit} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, island ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS {out}
FROM (SELECT *, sum(CASE WHEN {hit} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM {src})"""
_LAG = "(SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events)"
_CLAMP = lambda x, lo="0.0": f"greatest({lo}, least(1.0, {x}))"
_TITLE = r"trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'))"
_LOOSE = "list_filter(list_transform(regexp_split_to_array(translate(lower({x}), '/_-', '   '), {ws}), lambda t: regexp_replace(regexp_replace(t, '^[.,:;()\\[\\]{{}}!?\"''`]+', ''), '[.,:;()\\[\\]{{}}!?\"''`]+$', '')), lambda t: length(t) >= 2)"

_YEAR_LIST = r"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({x}, '\b(19\d{{2}}|20\d{{2}}|21\d{{2}})\b', 1), lambda y: CAST(y AS INTEGER)), lambda y: y BETWEEN 1990 AND 2100)))"

ORACLES: dict[str, str] = {
    "overview_by_grain": f"SELECT n_name, year, count(*) AS appearances, count(DISTINCT o_custkey) AS people, CAST(GROUPING(n_name, year) AS INTEGER) AS grain FROM {_APP} GROUP BY GROUPING SETS ((n_name, year), (n_name), ())",
    "overview_totals": f"SELECT count(DISTINCT n_name) AS conferences, count(DISTINCT (n_name, year)) AS years, count(DISTINCT o_custkey) AS people, count(*) AS appearances, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS good FROM {_APP}",
    "speaker_sums_json": f"SELECT user_id, CAST(sum({_K}) AS BIGINT) AS speakers, count(*) AS events FROM events GROUP BY user_id",
    "event_stage_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "link_events_by_year": "SELECT user_id, count(*) AS linked FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id",
    "filtered_event_counts": f"SELECT count(*) FILTER (event_type = 'view') AS routes, count(*) FILTER (event_type = 'click' AND {_K} > 0) AS good_pages FROM events",
    "conference_totals": f"SELECT n_name, count(DISTINCT o_custkey) AS people, count(*) AS appearances FROM {_APP} GROUP BY n_name",
    "year_group_cards": f"SELECT n_name, year, o_custkey, count(*) AS appearances, count(DISTINCT o_orderpriority) AS sessions FROM {_APP} GROUP BY ALL",
    "person_cards": "SELECT c_custkey, c_name, count(DISTINCT year(o_orderdate)) AS conferences, count(o_orderkey) AS appearances, CAST(NULL AS VARCHAR) AS photo_url FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name",
    "nested_people_list": "SELECT c_custkey, c_name, CAST(count(o_orderkey) AS INTEGER) AS n_items, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS item_keys FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name",
    "people_filtered": "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%mer#0000001%' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1997)",
    "token_or_search": "SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE 'small%' AND (" + " OR ".join(f"lower(coalesce({c}, '')) LIKE '%{t}%'" for c in ("p_name", "p_brand", "p_type") for t in ("ring", "brand#2", "promo")) + ")",
    "run_list_newest": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50",
    "event_cursor_page": "SELECT event_id, event_type, user_id FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 200",
    "latest_snapshot": f"WITH r AS (SELECT user_id, coalesce(max(event_id) FILTER (event_type = 'view'), max(event_id) FILTER (event_type = 'purchase')) AS event_id FROM events GROUP BY user_id) SELECT r.user_id, r.event_id, CASE WHEN e.props IS NULL THEN 0 ELSE {_K} END AS k FROM r LEFT JOIN events e ON r.event_id = e.event_id",
    "run_summary": f"SELECT user_id, count(DISTINCT lower(event_type)) AS stages, CAST(greatest(max({_K}), count(*) FILTER (event_type = 'click')) AS INTEGER) AS linked FROM events GROUP BY user_id",
    "run_status": "SELECT user_id, linked, dup, CASE WHEN linked > 150 THEN 'complete' WHEN dup > 150 THEN 'partial_duplicates' ELSE 'partial' END AS status FROM (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS linked, count(*) FILTER (event_type = 'error') AS dup FROM events GROUP BY user_id)",
    "latest_artifact": "SELECT source, max(doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY source",
    "backfill_join": "SELECT source, lang, count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 1 GROUP BY source, lang",
    "backup_closure": """WITH seed AS (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE lower(r_name) LIKE '%asia%'), people AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM seed)),
apps AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM people)), items AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM apps)), conf AS (SELECT s_nationkey AS k FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM items) UNION SELECT n_nationkey FROM seed)
SELECT 'people' AS table_name, count(*) AS rows FROM people UNION ALL SELECT 'appearances', count(*) FROM apps UNION ALL SELECT 'items', count(*) FROM items UNION ALL SELECT 'conferences', count(*) FROM conf""",
    "insert_if_absent": "WITH o AS (SELECT o_custkey, nullif(o_orderpriority, '4-NOT SPECIFIED') AS session, year(o_orderdate) AS year FROM orders) SELECT DISTINCT i.o_custkey, i.session FROM o i WHERE i.year >= 1996 AND NOT EXISTS (SELECT 1 FROM o e WHERE e.year < 1996 AND e.o_custkey IS NOT DISTINCT FROM i.o_custkey AND e.session IS NOT DISTINCT FROM i.session)",
    "completion_anti_join": "WITH o AS (SELECT o_custkey, lower(o_orderpriority) AS session, o_orderstatus FROM orders) SELECT session, count(*) AS missing FROM o WHERE o_orderstatus = 'P' AND NOT EXISTS (SELECT 1 FROM o f WHERE f.o_orderstatus = 'F' AND f.o_custkey = o.o_custkey AND f.session = o.session) GROUP BY session",
    "artifact_unpivot": "SELECT doc_id, 'clean_text' AS artifact, text AS data FROM documents WHERE text <> '' UNION ALL SELECT doc_id, 'lang', lang FROM documents WHERE lang <> '' UNION ALL SELECT doc_id, 'source', source FROM documents WHERE source <> ''",
    "kpi_sort": f"SELECT *, CAST(row_number() OVER (ORDER BY people DESC, appearances DESC, lower(n_name)) AS INTEGER) AS place FROM (SELECT n_name, count(DISTINCT o_custkey) AS people, count(*) AS appearances FROM {_APP} GROUP BY n_name)",
    "url_parts": f"SELECT page_id, {_SCHEME} AS scheme, {_HOST} AS host, {_PATH} AS path, {_QUERY} AS query FROM pages",
    "url_canonical": f"""WITH kv AS (SELECT page_id, url_decode(replace(split_part(x, '=', 1), '+', ' ')) AS k, url_decode(replace(substr(x, strpos(x, '=') + 1), '+', ' ')) AS v FROM (SELECT page_id, unnest(string_split({_QUERY}, '&')) AS x FROM pages) WHERE contains(x, '=')),
q AS (SELECT page_id, string_agg(replace(url_encode(k), '%20', '+') || '=' || replace(url_encode(v), '%20', '+'), '&' ORDER BY k, v) AS q FROM kv WHERE v <> '' AND NOT starts_with(lower(k), 'utm_') AND lower(k) NOT IN {_IN(K.TRACKING_KEYS)} GROUP BY page_id)
SELECT p.page_id, {_SCHEME} || '://' || {_HOST} || {_TRIM(f"regexp_replace(regexp_replace({_PATH}, ';[^/]*$', ''), '/{{2,}}', '/', 'g')")} || coalesce('?' || q, '') AS canonical FROM pages p LEFT JOIN q ON p.page_id = q.page_id""",
    "url_canonical_interaction": f"SELECT page_id, {_SCHEME} || '://' || {_HOST} || {_TRIM(_NOSLASH)} AS canonical FROM pages",
    "url_canonical_reasoner": f"SELECT page_id, {_SCHEME} || '://' || {_HOST} || {_TRIM(_PATH)} || CASE WHEN {_QUERY} = '' THEN '' ELSE '?' || {_QUERY} END AS canonical FROM pages",
    "url_registrable": f"SELECT page_id, {_SITE} AS domain FROM pages",
    "url_template": f"SELECT page_id, {_FULL} AS full, {_TPL.format(s=f'({_SEGS})[1:5]', hex='^[0-9a-f-]{8,}$')} AS hint, {_TPL.format(s=f'({_SEGS})[1:6]', hex='^[0-9a-f-]{8,}$')} AS key FROM pages",
    "url_branch": f"SELECT page_id, {_HOST} || '::' || {_FULL} AS branch, '/' || array_to_string(list_transform(({_SEGS})[1:2], lambda s: lower(s)), '/') AS prefix, coalesce(lower(({_SEGS})[1]), '') AS section FROM pages",
    "url_category": f"SELECT page_id, {_CAT} AS category, CASE WHEN lower(url) LIKE '%.pdf' THEN 'pdf_text' WHEN {_ANY('lower(url)', K.PLATFORM_HOSTS)} THEN 'playwright_network' ELSE 'http_static' END AS method, contains(lower(url), 'pdf') OR contains(lower(url), 'brochure') AS pdf, regexp_matches(url, '(?i)^https?://[^/?#]+') AS valid FROM pages",
    "content_type": "SELECT page_id, CASE WHEN page_id % 4 = 0 OR lower(url) LIKE '%.pdf' THEN 'pdf' WHEN page_id % 4 = 1 THEN 'json' WHEN page_id % 4 = 3 THEN 'html' ELSE 'unknown' END AS kind FROM pages",
    "nav_tokens": f"SELECT page_id, array_to_string(list_sort(list_distinct(list_concat(t, list_transform(list_filter(t, lambda x: x LIKE '%s' AND length(x) > 4), lambda x: substr(x, 1, length(x) - 1))))), ',') AS tokens FROM (SELECT page_id, {_NAV} AS t FROM pages)",
    "same_site_pairs": f"SELECT site, CAST(n * (n - 1) // 2 AS BIGINT) AS pairs FROM (SELECT {_SITE} AS site, count(*) AS n FROM pages GROUP BY 1)",
    "years_in_text": r"SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(url || ' 2019 x 1985 2024', '\b(19\d{2}|20\d{2}|21\d{2})\b', 1), lambda y: CAST(y AS INTEGER)), lambda y: y BETWEEN 1990 AND 2100))), ',') AS years FROM pages",
    "years_in_documents": r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\b(19\d{2}|20\d{2}|21\d{2})\b', 1), lambda y: CAST(y AS INTEGER)), lambda y: y BETWEEN 1990 AND 2100))), ',') AS years FROM documents",
    "top_focus_tokens": f"SELECT lang, token, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rn FROM (SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS token FROM documents) WHERE length(token) >= 3 AND token NOT IN {_IN(K.STOPWORDS)} GROUP BY ALL)) WHERE rn <= 50",
    "segments_overlap": "WITH d AS (SELECT doc_id, text, least(60, CASE WHEN length(text) <= 2400 THEN 1 ELSE CAST(ceil((length(text) - 2400) / 2150.0) AS BIGINT) + 1 END) AS c FROM documents) SELECT doc_id, CAST(i * 2150 AS INTEGER) AS start, CAST(length(substr(text, i * 2150 + 1, 2400)) AS INTEGER) AS n, md5(substr(text, i * 2150 + 1, 2400)) AS md5 FROM d, unnest(range(0, c)) u(i)",
    "paragraph_blocks": r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\n{2,}'), lambda p: length(trim(regexp_replace(p, '\s+', ' ', 'g'))) >= 30)) AS INTEGER) AS blocks FROM documents",
    "page_fingerprint_seen": r"SELECT doc_id, fp, row_number() OVER (PARTITION BY fp ORDER BY doc_id) > 1 AS seen FROM (SELECT doc_id, sha256(substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 12000)) AS fp FROM documents)",
    "candidate_first_seen": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1",
    "best_score_dedupe": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1",
    "longest_text_dedupe": "SELECT source, lang, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) = 1",
    "last_value_dedupe": "SELECT user_id, event_type, min(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type",
    "name_keys": "SELECT c_custkey, k AS name_key, k || '::' || substr(sha1('md | ' || lower(c_mktsegment) || ' |'), 1, 10) AS variant FROM (SELECT *, 'customer ' || substr(c_name, 10) AS k FROM customer)",
    "clean_text": rf"SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS sha FROM documents",
    "page_title": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "person_like": f"SELECT doc_id, {_ANY('lower(text)', K.PERSON_HINTS)} AS hit FROM documents",
    "link_keyword_score": "SELECT p_partkey, contains(lower(p_type), 'promo') OR contains(lower(p_type), 'standard') AS hit, CAST(" + " + ".join(f"CASE WHEN contains(lower(p_name || ' program speakers'), '{w}') THEN {v} ELSE 0 END" for w, v in K.LINK_WEIGHTS.items()) + " AS INTEGER) AS score FROM part",
    "template_diverse_topk": f"WITH q AS (SELECT page_id, {_SITE} AS site, '/' || array_to_string(list_transform(({_SEGS})[1:1], lambda s: lower(s)), '/') AS template, CAST(length(html) % 97 AS INTEGER) AS score FROM pages), c AS (SELECT site, greatest(2.0, max(score) * 0.2) AS cut FROM q GROUP BY site), n AS (SELECT site, cut, count(*) FILTER (score >= cut) AS good FROM q JOIN c USING (site) GROUP BY site, cut), p AS (SELECT q.* FROM q JOIN n USING (site) WHERE good < 3 OR score >= cut), r AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY site, template ORDER BY score DESC, page_id) > 1 THEN 1 ELSE 0 END AS again FROM p) SELECT page_id, site, template, score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY site ORDER BY again, score DESC, page_id) AS INTEGER) AS place FROM r) WHERE place <= 5",
    "branch_yield": "SELECT user_id, round(CASE WHEN v <= 0 THEN 0.0 ELSE " + _CLAMP("0.30 * least(1.0, c / greatest(v * 10, 1)::DOUBLE) + 0.25 * least(1.0, s / greatest(v * 3, 1)::DOUBLE) + 0.20 * least(1.0, p / greatest(v * 2, 1)::DOUBLE) + 0.15 * least(1.0, e / greatest(v * 8, 1)::DOUBLE) + 0.10 * least(1.0, p / greatest(v * 2, 1)::DOUBLE)") + " END, 9)::DOUBLE AS yield FROM (SELECT user_id, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'signup') AS s, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY user_id)",
    "memory_score": "SELECT user_id, round(" + _CLAMP("(0.6 * sh / v::DOUBLE + 0.4 * ah / v::DOUBLE) * exp(-greatest(0.0, (20000 - last) / 100.0::DOUBLE) / 30) + CASE WHEN v >= 2 THEN least(0.15, (v - 2) * 0.01) ELSE 0.0 END - least(0.5, (v % 5) * 0.08)") + ", 9)::DOUBLE AS score FROM (SELECT user_id, count(*) AS v, count(*) FILTER (event_type = 'click') AS sh, count(*) FILTER (event_type = 'purchase') AS ah, max(event_id) AS last FROM events GROUP BY user_id)",
    "enqueue_priority": "WITH e AS (SELECT event_id, value % 1.0::DOUBLE AS llm, user_id % 10 / 10.0::DOUBLE AS mem, CASE WHEN event_id % 7 = 0 THEN 0.0 WHEN event_id % 9 <= 1 THEN 0.95 WHEN event_id % 9 <= 4 THEN 0.75 ELSE 0.55 END AS nov, user_id % 4 / 4.0::DOUBLE AS yld, event_id % 5 AS depth, 2022 - (2010 + event_id % 5 * 4) AS d FROM events) SELECT event_id, round(" + _CLAMP(_CLAMP("0.45 * llm + 0.30 * mem + 0.15 * nov + 0.10 * yld - 0.05 * (depth + 1)", "0.01") + " + CASE WHEN d < 0 THEN -0.04 WHEN d <= 1 THEN 0.12 WHEN d <= 5 THEN 0.10 WHEN d <= 10 THEN 0.08 ELSE 0.06 END", "0.01") + ", 9)::DOUBLE AS priority FROM e",
    "rolling_yield_budget": "WITH e AS (SELECT event_id, user_id, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS c, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS a FROM events), x AS (SELECT event_id, user_id, CASE WHEN count(*) OVER w = 5 AND (sum(c) OVER w >= 10 OR sum(a) OVER w >= 3) THEN 1 ELSE 0 END AS expands FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) SELECT event_id, CAST(expands AS INTEGER) AS expands, CAST(least(120, 16 + 8 * sum(expands) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS budget FROM x",
    "novelty_zero_windows": "WITH n AS (SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS novel, count(*) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)), z AS (SELECT *, c = 10 AND novel = 0 AS idle FROM n), g AS (SELECT *, sum(CASE WHEN idle THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM z), s AS (SELECT *, CAST(sum(CASE WHEN idle THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS zero_windows FROM g) SELECT event_id, novel, zero_windows, zero_windows >= 3 AS stops FROM s",
    "zero_streaks": _STREAK.format(hit="event_type = 'click'", out="streak", src="events"),
    "stall_ticks": _STREAK.format(hit="event_type IS DISTINCT FROM was", out="ticks", src=_LAG),
    "minute_rate": "SELECT a.event_id, count(*) AS in_minute, count(*) > 2 AS over_limit FROM events a JOIN events b ON a.event_type = b.event_type AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 60 SECOND GROUP BY a.event_id",
    "template_cluster_growth": f"WITH p AS (SELECT page_id, {_HOST} AS host, {_FULL} AS template FROM pages), f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY template, host ORDER BY page_id) = 1 THEN 1 ELSE 0 END AS new FROM p) SELECT page_id, CAST(sum(new) OVER (PARTITION BY template ORDER BY page_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM f",
    "branch_running_totals": "SELECT event_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS clicks FROM events",
    "heading_carry_forward": "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS heading FROM conversations",
    "domain_guard": "SELECT event_id, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 2 AS held_back FROM events",
    "page_intent": "SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'pdf' WHEN list_has_any(t, {a}) THEN 'archive' WHEN list_has_any(t, {g}) THEN CASE WHEN list_has_any(t, ['session', 'plenary']) THEN 'session_detail' ELSE 'gatekeeper' END WHEN list_has_any(t, {u}) THEN 'non_content' ELSE 'listing' END AS intent FROM (SELECT doc_id, {t} AS t FROM documents)".format(a=_LIST(K.ARCHIVE), g=_LIST(K.GATEKEEPER), u=_LIST(K.UTILITY), t=_LOOSE.format(x="'https://x.org/' || source || ' ' || text", ws=_WS)),
    "llm_json_recovery": "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
    "stream_heartbeat": "SELECT user_id, count(*) AS events, max(event_id) AS last_id, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY user_id",
    "stream_template_memory": "WITH l AS (SELECT user_id, max(event_id) FILTER (event_type IN ('click', 'purchase')) AS last FROM events GROUP BY user_id) SELECT e.user_id, count(*) AS visits, count(*) FILTER (event_type = 'click') AS speaker_hits, count(*) FILTER (event_type = 'purchase') AS appearance_hits, count(*) FILTER (last IS NULL OR event_id > last) AS streak FROM events e JOIN l ON e.user_id = l.user_id GROUP BY e.user_id",
    "stem_tokens": f"""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(flatten(list_transform(list_filter(string_split(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> ''), lambda t: [t, CASE WHEN length(t) > 6 AND t LIKE '%ing' THEN regexp_replace(substr(t, 1, length(t) - 3), 'mm$', 'm') WHEN length(t) > 5 AND t LIKE '%ers' THEN substr(t, 1, length(t) - 3) WHEN length(t) > 4 AND t LIKE '%es' THEN substr(t, 1, length(t) - 2) WHEN length(t) > 4 AND t LIKE '%s' THEN substr(t, 1, length(t) - 1) WHEN length(t) > 5 AND t LIKE '%ed' THEN substr(t, 1, length(t) - 2) ELSE t END])), lambda t: length(t) >= 3 AND t NOT IN {_IN(K.STOPWORDS)} AND NOT regexp_full_match(t, '[0-9]+')))), ',') AS tokens FROM part""",
    "keep_lines": r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(0), ''), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')) AS sha FROM documents",
    "headings": r"SELECT page_id, array_to_string(list_filter(list_transform(list_concat(regexp_extract_all(html, '(?is)<h1(?:\s[^>]*)?>(.*?)</', 1), regexp_extract_all(html, '(?is)<h2(?:\s[^>]*)?>(.*?)</', 1), regexp_extract_all(html, '(?is)<h3(?:\s[^>]*)?>(.*?)</', 1)), lambda x: substr(trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), 1, 180)), lambda x: x <> '')[1:12], '|') AS headings FROM pages",
    "unique_links_union": f"SELECT site, count(DISTINCT trim(h)) AS links FROM (SELECT {_SITE} AS site, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href=[\"'']([^\"'']*)[\"''][^>]*>.*?</a>', 1)) AS h FROM pages) GROUP BY site",
    "attribution_year_ladder": r"SELECT page_id, coalesce(Y(url)[-1], Y(TITLE)[-1], CAST(page_id % 3 + 2020 AS INTEGER)) AS year, round(least(page_id % 10 / 10.0, 0.7), 6) AS confidence FROM pages".replace("Y(url)", _YEAR_LIST.format(x="url")).replace("Y(TITLE)", _YEAR_LIST.format(x=_TITLE)),
    "url_event_name": f"SELECT page_id, array_to_string(list_transform(string_split(trim(regexp_replace(s, '[^a-zA-Z0-9]+', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS event FROM (SELECT page_id, list_filter({_SEGS}, lambda s: lower(s) NOT IN ('events', 'event', 'program', 'agenda', 'schedule', 'index', 'details') AND NOT regexp_matches(lower(s), '^[0-9]+$') AND NOT regexp_matches(lower(s), '^[0-9a-f-]{{8,}}$') AND regexp_matches(s, '[a-zA-Z0-9]'))[-1] AS s FROM pages)",
    "network_json": """SELECT c_custkey AS id, p AS pos, CASE WHEN p = 0 THEN '{"speakers": [' || n || '], "title": "' || c_name || '"}' ELSE n END AS node FROM (SELECT *, '{"bio": "' || c_mktsegment || '", "name": "' || c_name || '"}' AS n FROM customer), (VALUES (0), (1)) v(p)""",
}

_RUNS = f"""WITH r AS (SELECT u.user_id, CASE WHEN u.user_id % 11 = 0 THEN 'Unknown' ELSE n_name END AS conference FROM (SELECT DISTINCT user_id FROM events) u JOIN nation ON u.user_id % 25 = n_nationkey WHERE u.user_id % 5 <> 0),
e AS (SELECT user_id, sum(CASE WHEN event_type = 'click' THEN {_K} ELSE 0 END) AS speakers, count(*) FILTER (WHERE event_type = 'view') AS routes, count(*) FILTER (WHERE event_type = 'click' AND {_K} > 0) AS good, count(*) FILTER (WHERE event_type = 'signup') AS log_pages, count(*) FILTER (WHERE event_type = 'signup' AND {_K} > 0) AS log_good FROM events GROUP BY user_id HAVING bool_or(event_type = 'click')),
f AS (SELECT user_id, conference, speakers, user_id % 2 = 0 AND log_pages > 0 AS logged, CASE WHEN speakers > 0 THEN CASE WHEN user_id % 2 = 0 AND log_pages > 0 THEN log_pages ELSE routes END ELSE 0 END AS pages, CASE WHEN speakers > 0 THEN CASE WHEN user_id % 2 = 0 AND log_pages > 0 THEN log_good ELSE good END ELSE 0 END AS good FROM r JOIN e USING (user_id)),
l AS (SELECT DISTINCT conference, event_id % 997 AS link FROM f JOIN events USING (user_id) WHERE logged AND speakers > 0 AND event_type = 'signup'),
a AS (SELECT c_nationkey, n_name AS conference, year(o_orderdate) AS y, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
y AS (SELECT DISTINCT c_nationkey, conference, y FROM a WHERE (c_nationkey, y) IN (SELECT (user_id % 25, 1992 + user_id % 7) FROM r)),
p AS (SELECT a.* FROM a JOIN y ON a.c_nationkey = y.c_nationkey AND a.y = y.y) """
ORACLES["overview_of_runs"] = _RUNS + """SELECT conference, CAST(sum(speakers) AS BIGINT) AS speakers, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(good) AS BIGINT) AS good, (SELECT count(*) FROM l WHERE l.conference = f.conference) AS links, (SELECT count(*) FROM y WHERE y.conference = f.conference) AS years, (SELECT count(*) FROM p WHERE p.conference = f.conference) AS appearances, (SELECT count(DISTINCT o_custkey) FROM p WHERE p.conference = f.conference) AS people FROM f GROUP BY conference"""
ORACLES["overview_run_totals"] = _RUNS + """SELECT count(*) FILTER (WHERE speakers > 0) AS runs, count(DISTINCT conference) AS conferences, CAST(coalesce(sum(speakers), 0) AS BIGINT) AS speakers, CAST(coalesce(sum(pages), 0) AS BIGINT) AS pages, CAST(coalesce(sum(good), 0) AS BIGINT) AS good, (SELECT count(DISTINCT link) FROM l) AS links, (SELECT count(*) FROM y) AS years, (SELECT count(*) FROM p) AS appearances, (SELECT count(DISTINCT o_custkey) FROM p) AS people FROM f"""
ORACLES["internal_links"] = rf"""WITH l AS (SELECT page_id, unnest(x) AS a, generate_subscripts(x, 1) - 1 AS pos, {_SCHEME} || '://' || regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS root FROM (SELECT page_id, url, regexp_extract_all(html, '(?s)<a href="[^"]*">.*?</a>') AS x FROM pages)),
u AS (SELECT page_id, pos, root || replace(regexp_extract(a, 'href="([^"]*)"', 1), '&amp;', '&') AS url, left(trim(regexp_replace(replace(regexp_replace(a, '<[^>]*>', ' ', 'g'), '&amp;', '&'), '\s+', ' ', 'g')), 200) AS anchor FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS nth FROM u)
SELECT page_id, CAST(pos AS INTEGER) AS pos, url, anchor FROM f WHERE nth = 1 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 60"""
ORACLES["stream_stalls"] = """WITH e AS (SELECT *, event_type IN ('click', 'purchase') AS p, sum(CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events),
t AS (SELECT *, sum(CASE WHEN p THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, island ORDER BY event_id) AS ticks FROM e)
SELECT user_id, CAST(CASE WHEN min(event_id) FILTER (ticks >= 6) IS NULL THEN arg_max(ticks, event_id) ELSE 6 END AS BIGINT) AS ticks, min(event_id) FILTER (ticks >= 6) AS stopped_at FROM t GROUP BY user_id"""
