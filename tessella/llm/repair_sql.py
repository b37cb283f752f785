"""DuckDB SQL of op11: the same repair as a recursive query, one turn of every conversation a step."""


def _more(x: str, cost: str, letters: str) -> str:
    """A cost of nine digits with the audit behind it, made dearer and longer."""
    return f"lpad(CAST(CAST(left({x}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({x}, 10) || '{letters}'"


_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(id) + 1), lambda i: CAST(ascii(substr(id, i, 1)) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"
_CLOSED = f"a0 AS c0, a1 AS c1, least(a2, {', '.join(_more(a, '2', 'I') for a in ('a0', 'a1', 'a3'))}) AS c2, least(a3, {_more('a2', '2', 'I')}, {_more('a0', '4', 'II')}, {_more('a1', '4', 'II')}) AS c3"


def _kept(state: str, initial: str) -> str:
    return f"CASE WHEN NOT gone AND r = '{initial}' THEN {_more(state, 'tr', 'K')} END"


def _named(state: str) -> str:
    return f"CASE WHEN NOT gone THEN {_more(state, '2 + tr', 'R')} END"


ORACLE = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
marked AS (SELECT raw.*, CAST({_CRC} % 20 AS INTEGER) AS m FROM raw, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN m = 1 THEN '' WHEN m = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM marked JOIN (VALUES (1), (2)) v(copy) ON copy <= CASE WHEN m = 0 THEN 0 WHEN m = 3 THEN 2 ELSE 1 END),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
judged AS (
  SELECT *, left(role, 1) AS r, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') AS cut,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM placed),
rows_ AS (SELECT *, blank OR again AS gone, CASE WHEN cut AND NOT blank AND NOT again THEN 1 ELSE 0 END AS tr FROM judged),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (again AND NOT blank) AS duplicate, sum(tr) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM rows_ GROUP BY conv_id),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS a0, CAST(NULL AS VARCHAR) AS a1, CAST(NULL AS VARCHAR) AS a2, CAST(NULL AS VARCHAR) AS a3 FROM (SELECT DISTINCT conv_id FROM raw)
  UNION ALL
  SELECT conv_id, i, {_more('c0', '3', 'D')}, least({_more('c1', '3', 'D')}, {_kept('c0', 's')}),
         least({_more('c2', '3', 'D')}, {', '.join([_named(c) for c in ('c0', 'c1', 'c3')] + [_kept(c, 'u') for c in ('c0', 'c1', 'c3')])}),
         least({_more('c3', '3', 'D')}, {_named('c2')}, {_kept('c2', 'a')})
  FROM (SELECT w.conv_id, x.i, x.r, x.gone, x.tr, {_CLOSED} FROM walk w JOIN rows_ x ON x.conv_id IS NOT DISTINCT FROM w.conv_id AND x.i = w.i + 1)),
ended AS (
  SELECT conv_id, least(c0, c3) AS best
  FROM (SELECT w.conv_id, {_CLOSED} FROM walk w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(c.n, 0))),
found AS (SELECT conv_id, CAST(left(best, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM ended),
tokens AS (
  SELECT conv_id, unnest(regexp_extract_all(audit, 'I*[KRD]')) AS token, generate_subscripts(regexp_extract_all(audit, 'I*[KRD]'), 1) AS i FROM found
  UNION ALL SELECT conv_id, regexp_extract(audit, 'I*$'), length(audit) + 1 FROM found),
letters AS (SELECT conv_id, i, unnest(range(1, length(token) + 1)) AS k, unnest(string_split(token, '')) AS e FROM tokens WHERE token <> ''),
shown AS (
  SELECT l.conv_id, l.e, x.role, x.text, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.i, l.k) AS o
  FROM letters l LEFT JOIN rows_ x ON x.conv_id IS NOT DISTINCT FROM l.conv_id AND x.i = l.i WHERE l.e <> 'D'),
named AS (SELECT *, max(CASE WHEN o = 1 AND e = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS s FROM shown),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY o) AS whole
  FROM named GROUP BY conv_id)
SELECT f.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, f.cost, f.audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM found f LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM f.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM f.conv_id
"""
