"""Preference formatting: one shared prompt, two masked completions.  Built-in expressions only.

For each pair of conversations the longest common prefix of (role, text) turns is
rendered once as the prompt; what follows is rendered for either side.  The mask
lists the character spans of a completion that a trainer learns from: text and end
mark of assistant turns.  Both sides travel in one shuffle on the pair's key.

Defined results: turns are ordered by (turn, role, text), null turn first;
repeated turn rows count as turns; null text is the empty text, null role the role
"unknown"; rows with a null key form no conversation and are left out; a key with
one side only gives status "unpaired", an empty prompt and a null other side;
identical conversations give two empty completions; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def _side(turns: str, side: str) -> Column:
    return F.expr(f"filter({turns}, t -> t.side = '{side}')")


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: t["body"]), "")


def _spans(turns: Column, base: Column) -> Column:
    """Spans learned from, relative to `base`: each turn knows where it starts in its own conversation."""
    learned = F.filter(turns, lambda t: t["role"] == "assistant")
    return F.transform(learned, lambda t: F.struct((t["at"] + t["head"] - base).alias("start"), (t["at"] + F.length(t["body"]) - base).alias("end")))


def preference_pairs(turns: DataFrame, key: str, chosen: Column) -> DataFrame:
    """Prompt and completions for each value of `key`.

    turns: one row a turn with columns `key`, conv_id, turn, role, text; `chosen`
    tells the two conversations of a key apart.
    """
    role, text = F.coalesce(F.col("role"), F.lit("unknown")), F.coalesce(F.col("text"), F.lit(""))
    head = F.concat(F.lit(OPEN), role, F.lit(CLOSE))
    rows = turns.where(F.col(key).isNotNull()).select(F.col(key).alias("pair_id"), F.when(chosen, "c").otherwise("r").alias("side"), "conv_id", "turn", role.alias("role"), F.length(head).alias("head"), F.concat(head, text, F.lit(END)).alias("body"))
    own = Window.partitionBy("pair_id", "side").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    # The explicit exchange on the pair serves the window and the aggregate below.
    placed = rows.repartition("pair_id").withColumn("n", F.row_number().over(own)).withColumn("at", F.sum(F.length("body")).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("body"))
    both = placed.groupBy("pair_id").agg(
        F.min(F.when(F.col("side") == "c", F.col("conv_id"))).alias("chosen_id"),
        F.min(F.when(F.col("side") == "r", F.col("conv_id"))).alias("rejected_id"),
        F.array_sort(F.collect_list(F.struct("side", "n", "role", "head", "at", "body"))).alias("turns"),
    )
    split = both.select("pair_id", "chosen_id", "rejected_id", _side("turns", "c").alias("c"), _side("turns", "r").alias("r"))
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["body"] == b["body"]), F.lit(False)))
    first = F.array_position(same, F.lit(False)).cast("int")
    prefix = split.withColumn("k", F.when(F.size(same) == 0, 0).when(first == 0, F.size("c")).otherwise(first - 1))
    rest = prefix.select("pair_id", "chosen_id", "rejected_id", "k", F.slice("c", 1, F.col("k")).alias("p"), *[F.when(F.size(x) > 0, F.slice(x, F.col("k") + 1, F.size(x))).alias(x) for x in ("c", "r")])
    prompt = _text(F.col("p"))
    ready = rest.withColumn("prompt", prompt).withColumn("base", F.length("prompt").cast("long"))
    return ready.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        F.col("k").alias("prompt_turns"),
        "prompt",
        _text(F.col("c")).alias("chosen"),
        _text(F.col("r")).alias("rejected"),
        _spans(F.col("c"), F.col("base")).alias("chosen_spans"),
        _spans(F.col("r"), F.col("base")).alias("rejected_spans"),
        F.when(F.col("chosen_id").isNull() | F.col("rejected_id").isNull(), "unpaired").otherwise("paired").alias("status"),
    )


def span_text(spans: str) -> Column:
    """Spans as "start-end,start-end"."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")


#: DuckDB SQL of op7: even conv_id is chosen, the next odd one rejected.
ORACLE = """
WITH t AS (
  SELECT conv_id // 2 AS pair_id, CASE WHEN conv_id % 2 = 0 THEN 'c' ELSE 'r' END AS side, conv_id, turn, coalesce(role, 'unknown') AS role,
         '<|' || coalesce(role, 'unknown') || '|>' || chr(10) AS head
       , '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS body
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (
  SELECT *, row_number() OVER w AS n,
         sum(length(body)) OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, body ROWS UNBOUNDED PRECEDING) - length(body) AS pos
  FROM t WINDOW w AS (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, body)),
d AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.n, r.n) AS n,
         c.body IS NOT NULL AND r.body IS NOT NULL AND c.role = r.role AND c.body = r.body AS same
  FROM (SELECT * FROM n WHERE side = 'c') c FULL JOIN (SELECT * FROM n WHERE side = 'r') r ON c.pair_id = r.pair_id AND c.n = r.n),
k AS (SELECT pair_id, coalesce(min(CASE WHEN NOT same THEN n END) - 1, max(n)) AS k FROM d GROUP BY pair_id),
b AS (
  SELECT n.pair_id, any_value(k.k) AS k,
         coalesce(string_agg(body, '' ORDER BY n.n) FILTER (side = 'c' AND n.n <= k.k), '') AS prompt
  FROM n JOIN k ON n.pair_id = k.pair_id GROUP BY n.pair_id),
s AS (
  SELECT n.pair_id, side, min(conv_id) AS conv_id, coalesce(string_agg(body, '' ORDER BY n.n) FILTER (n.n > b.k), '') AS body,
         coalesce(string_agg(CAST(CAST(pos + length(head) - length(b.prompt) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(pos + length(body) - length(b.prompt) AS BIGINT) AS VARCHAR), ',' ORDER BY n.n) FILTER (n.n > b.k AND role = 'assistant'), '') AS mask
  FROM n JOIN b ON n.pair_id = b.pair_id GROUP BY n.pair_id, side)
SELECT b.pair_id, c.conv_id AS chosen_id, r.conv_id AS rejected_id, CAST(b.k AS INTEGER) AS prompt_turns, b.prompt,
       c.body AS chosen, r.body AS rejected, c.mask AS chosen_mask, r.mask AS rejected_mask,
       CASE WHEN c.conv_id IS NULL OR r.conv_id IS NULL THEN 'unpaired' ELSE 'paired' END AS status
FROM b LEFT JOIN (SELECT * FROM s WHERE side = 'c') c ON b.pair_id = c.pair_id LEFT JOIN (SELECT * FROM s WHERE side = 'r') r ON b.pair_id = r.pair_id
"""
