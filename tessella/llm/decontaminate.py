"""Benchmark decontamination as a prefix-filtered set join.  Built-in expressions only.

A benchmark item's windows are its runs of 10 words (all its words, if fewer).  A
window's words are ordered by their rarity over all documents; a document can only
contain the window if it contains the rarest word, so that word alone is joined
(the prefix of a containment threshold of 1).  A hit word fixes where the window
would start; length and position bounds drop starts outside the text, and the
window's words are then compared exactly with the document's words at that place.

Defined results: null and empty texts have no words and no hits; null doc_id rows
are kept; repeated rows each get their result; benchmark rows with null item_id or
without words have no windows; an item text repeated under other ids counts for
each id; empty tables give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Rows up to which the benchmark's words or windows are broadcast; beyond it their joins shuffle. Documents are always joined by shuffling.
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), GAP), "")


def with_words(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep` and the words w of each text; the generator stops the optimizer from repeating the regex in every use of w."""
    return docs.select(*keep, F.explode(F.array(words(F.col("text")))).alias("w"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Distinct windows: win (words), len, items (sorted distinct ids as strings)."""
    w = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(width))
    each = w.select("item", F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("i"), "w", size.alias("len")).select("item", "len", F.slice("w", F.col("i"), F.col("len")).alias("win"))
    return each.groupBy("win", "len").agg(F.array_sort(F.collect_set("item")).alias("items"))


def keyed(documents: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the text's hash h, which together name a row (repeated rows have equal results)."""
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more).withColumn("h", F.xxhash64("text"))


def find_hits(docs: DataFrame, benchmark: DataFrame, *, width: int = WINDOW) -> DataFrame:
    """(doc_id, h, n_hit, items) of the documents (as from keyed) that contain a window."""
    wins = materialize(windows(benchmark, width), "bench-windows").withColumn("wid", F.xxhash64("win"))
    vocab = materialize(wins.select(F.explode("win").alias("word")).distinct(), "bench-words")
    n_vocab, n_wins = vocab.count(), wins.count()
    said = docs.select(F.explode(words(F.col("text"))).alias("word"))
    seen = said.join(_small(vocab, n_vocab), "word", "left_semi") if n_vocab <= BROADCAST_ROWS else said
    rarity = materialize(seen.groupBy("word").agg(F.count("*").alias("n")).join(vocab, "word", "left_semi"), "bench-rarity")
    # One anchor a window: its rarest word and the place of that word in it.
    placed = wins.select("wid", "len", F.posexplode("win").alias("off", "word")).join(rarity, "word")
    known = placed.groupBy("wid", "len").agg(F.min(F.struct("n", "word", "off")).alias("a"), F.count("*").alias("present")).where(F.col("present") == F.col("len"))
    anchors = materialize(known.select(F.col("a.word").alias("word"), F.col("a.off").alias("off"), "len", "wid"), "bench-anchors")

    at = with_words(docs, "doc_id", "h").select("doc_id", "h", F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "word"))
    start = F.col("pos") - F.col("off")
    starts = at.join(_small(anchors, n_wins), "word").where((start >= 0) & (start + F.col("len") <= F.col("n_words"))).select("doc_id", "h", start.alias("start"), "wid")
    cand = materialize(starts.distinct(), "bench-starts")
    full = cand.join(_small(wins, n_wins), "wid").groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "len", "win", "items")).alias("cand"))
    keys = materialize(full, "bench-candidates")
    near = docs.alias("d").join(keys.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.h") == F.col("k.h"))).select("d.doc_id", "d.h", "text", "cand")
    exact = with_words(near, "doc_id", "h", "cand")
    hits = exact.select("doc_id", "h", F.explode(F.array(F.expr("filter(cand, c -> slice(w, c.start + 1, c.len) = c.win)"))).alias("hit")).where(F.size("hit") > 0)
    found = hits.select(
        "doc_id",
        "h",
        F.size(F.array_distinct(F.flatten(F.expr("transform(hit, c -> sequence(c.start, c.start + c.len - 1))")))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.expr("transform(hit, c -> c.items)")))).alias("items"),
    ).dropDuplicates(["doc_id", "h"])
    return materialize(found, "bench-hits")


def clean(documents: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """documents without those that contain a window."""
    names = documents.columns
    h, i, th = fresh(names, "_h", "_id", "_th")
    docs = documents.withColumn(h, F.xxhash64(F.coalesce("text", F.lit(""))))
    found = find_hits(keyed(documents), benchmark, **params).select(F.col("doc_id").alias(i), F.col("h").alias(th))
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(h) == F.col(th)), "left_anti").select(*names)


def contamination(documents: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    docs = keyed(documents)
    found = find_hits(docs, benchmark, **params)
    base = docs.select("doc_id", "h", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = base.alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.h") == F.col("f.h")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select("d.doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


#: DuckDB SQL of op8.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
v AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
      FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) u(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM v),
p AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM d, lens, unnest(range(1, len(w) - n + 2)) u(i) WHERE len(w) >= n),
m AS (SELECT p.r, p.i, p.n, v.item FROM p JOIN v ON p.win = v.win AND p.n = v.n),
h AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT r, i, n FROM m), unnest(range(i, i + n)) u(j) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
