"""Queries of run control, targets of records, reserved seats and reachability, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scores
from ..functions import url as U
from ..operators import navigation, runs
from .marts import read
from .oracles import _HOST, _K, _LIST, _PATH, _SCHEME, _SITE


def _told(kind: str, counters: str = "{}", metrics: str = "{}", gauges: str = "{}"):
    return F.when(F.col("event_type") == kind, F.format_string(f'{{"counters": {counters}, "metrics": {metrics}, "gauges": {gauges}}}'.replace("%k", "%1$d"), F.col("k")))


def run_counters(s: SparkSession, d: str) -> DataFrame:
    """All metrics of every user's events as a run, told by payloads of four stages; branches are minutes of the hour."""
    e = read(s, d, "events").withColumn("k", scores.safe_int(F.col("props"), "$.k"))
    payload = F.coalesce(
        _told("view", metrics='{"pages_visited": 1, "markdown_chars_processed": %k, "unknown_metric": 5}', gauges='{"frontier_size": %k}'),
        _told("click", counters='{"linked_appearances": 2, "llm_attempts": 1, "blocked_pages": 1}', metrics='{"normalized_speakers": %k}'),
        _told("signup", counters='{"llm_failures": null, "stalls_recovered": 1}', gauges='{"branch_count": %k, "frontier_size": 7}'),
        F.when(F.col("event_type") == "error", "not json"),
    )
    told = e.select("user_id", "event_id", payload.alias("data"))
    branches = e.groupBy("user_id", F.minute("ts").alias("branch")).agg(F.count_if(F.col("event_type") == "purchase").alias("new_people"), F.count_if((F.col("event_type") == "click") & (F.col("k") > 95)).alias("linked"))
    return runs.metrics(told, "user_id", "event_id", "data", branches)


def run_status_ladder(s: SparkSession, d: str) -> DataFrame:
    """Final states of runs: users are runs, days with a purchase or an error their discovered years."""
    e = read(s, d, "events")
    years = e.where(F.col("event_type").isin("purchase", "error")).groupBy("user_id", F.floor(F.col("event_id") / 200).alias("y")).agg(F.count_if(F.col("event_type") == "purchase").alias("linked"), F.count_if(F.col("event_type") == "error").alias("duplicates"))
    r = e.groupBy("user_id").agg(F.count_if((F.col("event_type") == "error") & (F.col("value") > 40)).alias("blocked_pages")).select("user_id", (F.col("user_id") % 13 == 0).alias("cancelled"), (F.col("user_id") % 17 == 0).alias("stalled"), "blocked_pages")
    few = years.where("user_id % 7 != 3 and (user_id % 3 != 0 or linked > 0)")
    return runs.run_status(few, r, "user_id")


def year_states(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events").groupBy("user_id", F.floor(F.col("event_id") / 500).alias("y")).agg(F.count_if(F.col("event_type") == "purchase").alias("linked"), F.count_if(F.col("event_type") == "error").alias("duplicates"))
    return e.select("user_id", "y", runs.year_status(F.col("linked"), F.col("duplicates")).alias("s")).select("user_id", "y", "s.*")


def run_transitions(s: SparkSession, d: str) -> DataFrame:
    """State of a user's run after each event: views begin it, the first error or the first purchase above 30 ends it."""
    e = read(s, d, "events").select("event_id", "user_id", "event_type", "value")
    stage = F.when(F.col("event_type") == "view", "fetch_route").when((F.col("event_type") == "purchase") & (F.col("value") > 30), "complete").when((F.col("event_type") == "error") & (F.col("value") > 20), "error").otherwise("other")
    return runs.transitions(e, "user_id", "event_id", stage).select("event_id", "state")


def _target(name: Column, year: Column, confidence: float) -> Column:
    return F.struct(name.alias("name"), year.cast("int").alias("year"), F.lit(confidence).alias("confidence"))


def _assigned(s: SparkSession, d: str) -> DataFrame:
    """Orders as records: some name their own conference, some are found in a batch, others have a year in their address or one known target."""
    c = read(s, d, "customer").join(F.broadcast(read(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_name")
    o = read(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    year = F.year("o_orderdate")
    none = F.array().cast(runs.KIND)
    explicit = F.when(F.col("o_orderkey") % 5 == 0, F.array(_target(F.col("n_name"), year, 0.9), _target(F.lit(" "), year, 0.9), _target(F.col("n_name"), year - 100, 0.9)))
    batch = F.when(F.col("o_orderkey") % 7 == 0, F.array(_target(F.col("n_name"), year, 0.6), _target(F.lit("OTHER"), year, 0.5)))
    known = F.when(F.col("c_nationkey") % 3 == 0, F.transform(F.sequence(F.lit(1992), F.lit(1996)), lambda y: _target(F.col("n_name"), y, 0.7))).when(F.col("c_nationkey") % 3 == 1, F.array(_target(F.col("n_name"), F.lit(1995), 0.7))).otherwise(none)
    url = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("https://x.org/1993/"), year.cast("string"), F.lit("/program"))).otherwise("https://x.org/program")
    hint = F.when(F.col("c_custkey") % 11 == 0, " RUN ")
    rows = o.select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("session"), explicit.alias("explicit"), batch.alias("batch"), known.alias("known"), url.alias("url"), hint.alias("hint"))
    out = runs.targets(rows, F.col("explicit"), F.col("batch"), F.col("known"), F.col("url"), F.col("hint"))
    return out.select("o_orderkey", "o_custkey", "session", "rung", "conference", "year", "target_confidence")


def assigned_targets(s: SparkSession, d: str) -> DataFrame:
    return _assigned(s, d).select("o_orderkey", "rung", "conference", "year", "target_confidence")


def link_outcomes(s: SparkSession, d: str) -> DataFrame:
    """How many rows each rung linked, skipped as duplicates or left; stored appearances are those of orders before 1993."""
    o = read(s, d, "orders").where("year(o_orderdate) < 1993")
    c = read(s, d, "customer").join(F.broadcast(read(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    stored = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", F.col("n_name").alias("conference"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("session"))
    rows = runs.links(_assigned(s, d), stored, ["o_custkey", "conference", "year", "session"], "o_orderkey")
    return rows.groupBy("rung", "outcome").agg(F.count("*").alias("n"))


def event_pages(s: SparkSession, d: str) -> DataFrame:
    return runs.event_pages(read(s, d, "events").select("user_id", "event_id"), "user_id", "event_id", 25)


def _site_pool(s: SparkSession, d: str) -> DataFrame:
    """Pages of a site as its candidate links: the first page is the seed, the second one the page they stand on."""
    p = read(s, d, "pages").select("page_id", "url", U.registrable(F.col("url")).alias("site"), (F.length("html") % 97 / 5.0).alias("score"))
    ids = p.groupBy("site").agg(F.sort_array(F.collect_set(U.prefix(F.col("url")))).alias("all"), F.min_by(U.prefix(F.col("url")), "page_id").alias("seed"))
    joined = p.join(ids, "site").withColumn("prefix", U.prefix(F.col("url")))
    by_score = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("score"), "page_id"))
    return joined.withColumn("nth", by_score)


def reserved_seats(s: SparkSession, d: str) -> DataFrame:
    """Six links a site with seats kept for branches other than the seed's, the first ten by score chosen before."""
    p = _site_pool(s, d)
    core = (F.col("prefix") == F.col("seed")) | (F.col("nth") <= 8)
    signal = F.col("page_id") % 9 == 0
    chosen = p.withColumn("place", F.when(F.col("nth") <= 6, F.col("nth")))
    out = navigation.reserve_cross(chosen, "site", "nth", "score", core, F.size(U.segments(F.col("url"))), signal, 6)
    return out.where("place IS NOT NULL").select("site", "place", "page_id")


def reachable_pages(s: SparkSession, d: str) -> DataFrame:
    """Pages that the first page of each site reaches in four steps over links that pages of the site share."""
    p = read(s, d, "pages").select("page_id", "url", "html")
    seeds = p.groupBy(U.host(F.col("url")).alias("seed")).agg(F.min("page_id").alias("page_id"))
    return navigation.reachable(navigation.link_targets(p), seeds)


def candidate_links(s: SparkSession, d: str) -> DataFrame:
    """Why candidates are kept or dropped: pages of a site as what its first page leads to, with types and reasons."""
    p = read(s, d, "pages").select("page_id", "url", U.registrable(F.col("url")).alias("site"))
    seeds = p.groupBy("site").agg(F.min_by("url", "page_id").alias("seed"))
    kind = F.when(F.col("page_id") % 4 == 0, "non_content").when(F.col("page_id") % 4 == 1, "Listing ").when(F.col("page_id") % 4 == 2, "")
    reason = F.when(F.col("page_id") % 3 == 0, "speakers of the day").when(F.col("page_id") % 3 == 1, "plain words")
    rows = p.join(seeds, "site").select("page_id", "site", "url", "seed", F.col("seed").alias("page"), kind.alias("page_type"), reason.alias("reason"), F.lit("/hint").alias("branch_hint"))
    out = navigation.judge_candidates(rows, "seed", "page", F.array(F.lit("plain")), F.col("page_id") % 2 == 0, ["site"], "page_id")
    return out.select("page_id", "kept", "why")


QUERIES = {f.__name__: f for f in (run_counters, run_status_ladder, year_states, run_transitions, assigned_targets, link_outcomes, event_pages, reserved_seats, reachable_pages, candidate_links)}

_PREFIX = f"'/' || lower(array_to_string(list_filter(string_split({_PATH}, '/'), lambda s: s <> '')[1:2], '/'))"
_METRICS = {
    "pages_visited": "count(*) FILTER (event_type = 'view')",
    "markdown_chars_processed": "sum(k) FILTER (event_type = 'view')",
    "frontier_size": "arg_max(CASE WHEN event_type = 'view' THEN k ELSE 7 END, event_id) FILTER (event_type IN ('view', 'signup'))",
    "appearances_linked": "2 * count(*) FILTER (event_type = 'click')",
    "llm_calls": "count(*) FILTER (event_type = 'click')",
    "normalized_speakers": "sum(k) FILTER (event_type = 'click')",
    "stalls_recovered": "count(*) FILTER (event_type = 'signup')",
    "branch_count": "arg_max(k, event_id) FILTER (event_type = 'signup')",
}
_TARGETS = """
o AS (SELECT o_orderkey, o_custkey, o_orderpriority AS session, n_name, c_nationkey, year(o_orderdate) AS y, CASE WHEN o_custkey % 11 = 0 THEN 'RUN' END AS hint FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
r AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 'explicit' WHEN o_orderkey % 7 = 0 THEN 'batch' WHEN o_orderkey % 2 = 0 AND c_nationkey % 3 = 0 AND greatest(y, 1993) <= 1996 THEN 'url_year' WHEN o_orderkey % 2 = 0 AND c_nationkey % 3 = 1 AND greatest(y, 1993) = 1995 THEN 'url_year' WHEN c_nationkey % 3 = 1 THEN 'only_known' ELSE 'unresolved' END AS rung FROM o),
t AS (SELECT o_orderkey, o_custkey, session, rung, coalesce(hint, n_name) AS conference, y AS year, CASE WHEN rung = 'explicit' THEN 0.9 ELSE 0.6 END AS target_confidence FROM r WHERE rung IN ('explicit', 'batch')
  UNION ALL SELECT o_orderkey, o_custkey, session, rung, coalesce(hint, 'OTHER'), y, 0.5 FROM r WHERE rung = 'batch'
  UNION ALL SELECT o_orderkey, o_custkey, session, rung, coalesce(hint, n_name), CASE WHEN rung = 'only_known' THEN 1995 ELSE greatest(y, 1993) END, 0.7 FROM r WHERE rung IN ('url_year', 'only_known')
  UNION ALL SELECT o_orderkey, o_custkey, session, rung, NULL, NULL, NULL FROM r WHERE rung = 'unresolved')"""
_POOL = f"""
p AS (SELECT page_id, url, {_SITE} AS site, {_PREFIX} AS prefix, length(html) % 97 / 5.0 AS score, len(list_filter(string_split({_PATH}, '/'), lambda s: s <> '')) AS depth, page_id % 9 = 0 AS sig FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, page_id) AS nth, first_value(prefix) OVER (PARTITION BY site ORDER BY page_id) AS seed FROM p),
q AS (SELECT *, prefix = seed OR nth <= 8 AS core FROM n),
x AS (SELECT site, page_id, sig, row_number() OVER (PARTITION BY site ORDER BY score + 0.2 * depth + CASE WHEN sig THEN 1.2 ELSE 0 END DESC, nth) AS rank FROM q WHERE NOT core),
f AS (SELECT site, min(rank) AS f FROM x WHERE sig GROUP BY site),
w AS (SELECT x.site, x.page_id FROM x LEFT JOIN f ON x.site = f.site WHERE CASE WHEN f.f > 1 THEN rank = f.f ELSE rank = 1 END),
big AS (SELECT site FROM q GROUP BY site HAVING count(*) > 3)"""

ORACLES = {
    "run_counters": f"""WITH e AS (SELECT *, {_K} AS k FROM events), b AS (SELECT user_id, count(*) FILTER (hit) AS high FROM (SELECT user_id, minute(ts) AS m, bool_or(event_type = 'purchase' OR event_type = 'click' AND k > 95) AS hit FROM e GROUP BY user_id, m) GROUP BY user_id),
c AS (SELECT user_id, {', '.join(f'{v} AS {m}' for m, v in _METRICS.items())} FROM e GROUP BY user_id)
SELECT c.user_id, metric, CAST(coalesce(CASE metric WHEN 'high_yield_branches' THEN high {' '.join(f"WHEN '{m}' THEN {m}" for m in _METRICS)} END, 0) AS BIGINT) AS value FROM c JOIN b ON c.user_id = b.user_id, (SELECT unnest({_LIST(K.RUN_METRICS)}) AS metric)""",
    "run_status_ladder": """WITH y AS (SELECT user_id, event_id // 200 AS y, count(*) FILTER (event_type = 'purchase') AS linked, count(*) FILTER (event_type = 'error') AS dup FROM events WHERE event_type IN ('purchase', 'error') GROUP BY ALL),
f AS (SELECT user_id, count(*) AS n, count(*) FILTER (linked = 0) AS partial FROM y WHERE user_id % 7 <> 3 AND (user_id % 3 <> 0 OR linked > 0) GROUP BY user_id),
r AS (SELECT user_id, user_id % 13 = 0 AS cancelled, user_id % 17 = 0 AS stalled, count(*) FILTER (event_type = 'error' AND value > 40) AS blocked_pages FROM events GROUP BY user_id)
SELECT r.*, coalesce(n, 0) AS years, CASE WHEN cancelled OR stalled THEN 'partial' WHEN n IS NULL THEN CASE WHEN blocked_pages > 0 THEN 'partial' ELSE 'error' END WHEN partial = 0 THEN 'complete' ELSE 'partial' END AS status,
CASE WHEN cancelled THEN 'Cancelled by user' WHEN stalled THEN 'Run terminated after repeated normalization stalls' WHEN n IS NULL AND blocked_pages > 0 THEN 'No attributable conference-years found; sources were blocked or inconclusive' WHEN n IS NULL THEN 'No attributable conference-years discovered' END AS message
FROM r LEFT JOIN f ON r.user_id = f.user_id""",
    "year_states": "SELECT user_id, y, CASE WHEN l > 0 THEN 'complete' ELSE 'partial' END AS status, CASE WHEN l > 0 THEN 'Linked ' || l || ' physician appearance(s)' WHEN d > 0 THEN 'Only duplicate appearance records found' ELSE 'Conference-year discovered but no attributable physician links' END AS notes FROM (SELECT user_id, event_id // 500 AS y, count(*) FILTER (event_type = 'purchase') AS l, count(*) FILTER (event_type = 'error') AS d FROM events GROUP BY ALL)",
    "run_transitions": "WITH f AS (SELECT user_id, min(event_id) FILTER (event_type = 'view') AS b, min(event_id) FILTER (event_type = 'purchase' AND value > 30) AS c, min(event_id) FILTER (event_type = 'error' AND value > 20) AS x FROM events GROUP BY user_id) SELECT event_id, CASE WHEN event_id >= least(c, x) THEN CASE WHEN c IS NOT NULL AND (x IS NULL OR c < x) THEN 'complete' ELSE 'error' END WHEN event_id >= b THEN 'running' ELSE 'pending' END AS state FROM events JOIN f USING (user_id)",
    "assigned_targets": f"WITH {_TARGETS} SELECT o_orderkey, rung, conference, CAST(year AS INTEGER) AS year, target_confidence FROM t",
    "link_outcomes": f"""WITH {_TARGETS}, s AS (SELECT DISTINCT o_custkey, n_name AS conference, y AS year, session FROM o WHERE y < 1993),
m AS (SELECT t.*, row_number() OVER (PARTITION BY o_custkey, conference, year, session ORDER BY o_orderkey, rung) AS nth, EXISTS (SELECT 1 FROM s WHERE s.o_custkey = t.o_custkey AND s.conference IS NOT DISTINCT FROM t.conference AND s.year IS NOT DISTINCT FROM t.year AND s.session IS NOT DISTINCT FROM t.session) AS there FROM t)
SELECT rung, CASE WHEN rung = 'unresolved' THEN 'unresolved' WHEN there OR nth > 1 THEN 'duplicate' ELSE 'linked' END AS outcome, count(*) AS n FROM m GROUP BY ALL""",
    "event_pages": "SELECT user_id, CAST(n // 25 AS INTEGER) AS page, count(*) AS events, min(event_id) AS first_id, max(event_id) AS next_cursor FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events) GROUP BY ALL",
    "reserved_seats": f"""WITH {_POOL},
new AS (SELECT w.* FROM w JOIN q ON w.page_id = q.page_id JOIN big ON w.site = big.site WHERE q.nth > 6),
o AS (SELECT site, max(nth) AS nth FROM q WHERE nth <= 6 AND core AND site IN (SELECT site FROM new) GROUP BY site),
r AS (SELECT site, page_id, nth AS o FROM q WHERE nth <= 6 AND (site, nth) NOT IN (SELECT site, nth FROM o) UNION ALL SELECT site, page_id, 100 FROM new)
SELECT site, CAST(row_number() OVER (PARTITION BY site ORDER BY o) AS INTEGER) AS place, page_id FROM r""",
    "reachable_pages": f"""WITH RECURSIVE l AS (SELECT DISTINCT page_id, {_SCHEME} || '://' || {_HOST} || unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS url FROM pages),
e AS (SELECT DISTINCT a.page_id AS a, b.page_id AS b FROM l a JOIN l b ON a.url = b.url),
r AS (SELECT {_HOST} AS seed, min(page_id) AS page_id, 0 AS depth FROM pages GROUP BY seed UNION SELECT seed, b, depth + 1 FROM r JOIN e ON a = page_id WHERE depth < 4)
SELECT seed, page_id, min(depth) AS depth FROM r GROUP BY seed, page_id""",
}
