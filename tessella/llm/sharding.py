"""Balanced label propagation: documents to shards of equal row counts, links kept together.

Documents with equal texts are linked through their group (a star, never all
pairs).  Linked documents move in chunks of a group; in each round every group
proposes its chunks to the shard where most of the group already is, and a shard
accepts the proposals with the largest gain up to its quota, read off a bounded
histogram.  A shard is open to a group only while it has room for one of its chunks,
so a group larger than a shard goes on to the next one; rounds end when nothing moves
(or after twice as many as there are shards).  Unlinked documents then fill every shard
to its exact size, so the law ``rows`` (counts at most one apart) holds.  ``cut_links``
counts what an assignment cuts.

Only narrow columns are shuffled.  Defined results: null text has size 1 and the
checksum of the empty text and is linked with other null texts; null doc_id rows
are placed like others; repeated rows each get a slot; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

SUBS = 1024  # most chunks of a group


def ranked(df: DataFrame, keys: list[str], order: list[Column], out: str, buckets: int = 1024) -> DataFrame:
    """Adds `out`, the gapless rank from 0 within keys, without one task per key.

    Rows are ranked inside hash buckets and shifted by the running bucket counts,
    of which there are at most buckets x key values.
    """
    at = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = at.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    shift = counts.select(*keys, "_b", (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_n")).alias("_o"))
    within = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)) - 1
    return at.withColumn("_r", within).join(shift, [*keys, "_b"]).withColumn(out, F.col("_r") + F.col("_o")).drop("_b", "_r", "_o")


def _best(state: DataFrame, room: dict[int, int]) -> DataFrame:
    """For each group the shard that holds most of it, among those with room for its largest chunk."""
    held = state.groupBy("grp", "shard").agg(F.sum("n").alias("held"), F.max("n").alias("chunk"))
    left = F.element_at(F.create_map(*[F.lit(x) for s, n in room.items() for x in (s, n)]), F.col("shard"))
    of_group = Window.partitionBy("grp")
    w = of_group.orderBy(F.desc("held"), F.pmod(F.xxhash64("grp", "shard"), F.lit(1 << 20)), "shard")
    fits = held.withColumn("chunk", F.max("chunk").over(of_group)).where(left >= F.col("chunk"))
    best = fits.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("grp", F.col("shard").alias("to"), F.col("held").alias("held_to"))
    own = held.select("grp", "shard", F.col("held").alias("held_own"))
    return own.join(best, "grp").where("shard != to and (held_to > held_own or (held_to = held_own and to < shard))")


def cut_links(rows: DataFrame, group: str = "grp", shard: str = "shard", n: str = "n") -> DataFrame:
    """(links, cut): a group of m rows has m - 1 links, and those of rows outside the shard that holds most of it are cut."""
    held = rows.groupBy(group, shard).agg(F.sum(n).alias("held"))
    per = held.groupBy(group).agg(F.sum("held").alias("all"), F.max("held").alias("most"))
    return per.agg(F.coalesce(F.sum(F.col("all") - 1), F.lit(0)).alias("links"), F.coalesce(F.sum(F.col("all") - F.col("most")), F.lit(0)).alias("cut"))


def propagate(state: DataFrame, shards: int, quota: int, rounds: int | None = None) -> DataFrame:
    """Moves (grp, sub, n) chunks between shards until none moves; no shard takes chunks beyond quota."""
    for _ in range(2 * shards if rounds is None else rounds):
        load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = {s: quota - load.get(s, 0) for s in range(shards)}
        if max(room.values()) <= 0:
            break
        level = 63 - F.floor(F.log2(F.col("held_to") + 1)).cast("long")
        wish = state.join(_best(state, room), ["grp", "shard"]).withColumn("lvl", level * 4096 + F.pmod(F.xxhash64("grp", "sub"), F.lit(4096)))
        wish = materialize(wish.select("grp", "sub", "to", "lvl", "n"), "shard-wishes", small=True)
        # Most rows of this histogram: shards x 64 gain levels x 4096 slices, whatever the input.
        hist = wish.groupBy("to", "lvl").agg(F.sum("n").alias("n")).withColumn("run", F.sum("n").over(Window.partitionBy("to").orderBy("lvl")))
        fits = F.lit(False)
        for s in range(shards):
            fits = fits | ((F.col("to") == s) & (F.col("run") <= room[s]))
        edge = {r["to"]: r["lvl"] for r in hist.where(fits).groupBy("to").agg(F.max("lvl").alias("lvl")).collect()}
        if not edge:
            discard(wish)
            break
        taken = F.lit(False)
        for s, e in edge.items():
            taken = taken | ((F.col("to") == s) & (F.col("lvl") <= e))
        moved = state.join(wish.where(taken).select("grp", "sub", "to"), ["grp", "sub"], "left").select("grp", "sub", F.coalesce("to", "shard").alias("shard"), "n")
        before, state = state, materialize(moved, "shard-state", small=True)
        discard(wish, before)
    return state


def shard_documents(documents: DataFrame, *, shards: int = 16, rounds: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text, F.length(text)).alias("grp"), F.monotonically_increasing_id().alias("_row"))
    base = materialize(base, "shard-base")
    total = base.count()
    quota = total // shards
    counts = base.groupBy("grp").agg(F.count("*").alias("members"))
    linked = counts.where("members > 1").select("grp", "members")
    # A group's chunks are of one row while it is small and of about members / SUBS when it is large.
    sub = F.pmod(F.xxhash64("_row", F.lit(3)), F.least(F.lit(SUBS), F.col("members"))).cast("int")
    docs = materialize(base.join(linked, "grp", "left").withColumn("sub", F.when(F.col("members").isNotNull(), sub)).drop("members"), "shard-docs")
    seed = F.pmod(F.xxhash64("grp", F.floor(F.col("sub") / 8)), F.lit(shards)).cast("int")
    state = docs.where("sub is not null").groupBy("grp", "sub").agg(F.count("*").alias("n")).withColumn("shard", seed)
    state = propagate(materialize(state, "shard-state"), shards, quota, rounds)

    placed = docs.join(state.select("grp", "sub", "shard"), ["grp", "sub"], "left")
    order = [F.col("grp"), F.col("_row")]
    # Linked rows stay where the rounds put them, up to the shard's exact size; all others fill what is left.
    want = {s: quota + (s < total % shards) for s in range(shards)}
    size_of = F.element_at(F.create_map(*[F.lit(x) for s in range(shards) for x in (s, want[s])]), F.col("shard"))
    stay = ranked(placed.where("shard is not null"), ["shard"], order, "rank")
    stay = materialize(stay.withColumn("shard", F.when(F.col("rank") < size_of, F.col("shard"))).drop("rank").unionByName(placed.where("shard is null")), "shard-placed")
    load = {r["shard"]: r["n"] for r in stay.where("shard is not null").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    fill, upto = F.lit(shards - 1), 0
    edges = []
    for s in range(shards):
        upto += want[s] - load.get(s, 0)
        edges.append((s, upto))
    for s, e in reversed(edges):
        fill = F.when(F.col("rank") < e, F.lit(s)).otherwise(fill)
    free = ranked(stay.where("shard is null").withColumn("_all", F.lit(0)), ["_all"], order, "rank", buckets=8192).withColumn("shard", fill).drop("rank", "_all")
    whole = stay.where("shard is not null").unionByName(free, allowMissingColumns=True)
    out = ranked(whole.withColumn("shard", F.col("shard").cast("int")), ["shard"], [F.col("doc_id"), F.col("_row")], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
