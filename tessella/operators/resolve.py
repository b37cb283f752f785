"""Get-or-create resolution of incoming people against a stored set and each other.

Records resolve inside their name block, beside the stored people of that name; a
name without any goes to the best-scoring stored one of at least 88.  Order matters
within a block only, so blocks run in parallel (``cogroup`` and ``applyInPandas``).
New names are not compared fuzzily with each other here; linkage.merge_close does that.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..session import ship
from . import linkage

FIELDS = ["designation", "affiliation", "location", "specialty", "profile_url"]


def variant(base: str, row: dict) -> str:
    mark = names.ascii_fold(" | ".join(row.get(k) or "" for k in ("designation", "affiliation", "location"))) or "unknown-context"
    return f"{base}::{hashlib.sha1(mark.encode()).hexdigest()[:10]}"


def profile(r: dict) -> dict:
    return {k: (None if pd.isna(r[k]) else r[k]) for k in FIELDS}


def resolve_block(rows: pd.DataFrame, stored: pd.DataFrame | None = None) -> pd.DataFrame:
    """Final keys of one name's records in order of arrival; a stored person's gaps are filled as records come."""
    known = [] if stored is None else stored.rename(columns=lambda c: c.removeprefix("stored_")).sort_values("id").to_dict("records")
    people: dict[str, dict] = {r["name_key"]: profile(r) for r in known}
    out = []
    for r in rows.sort_values("id").to_dict("records"):
        row = profile(r)
        base = r["name_key"]
        own = people.get(base)
        if own is not None:
            key = variant(base, row) if names.conflict(row, own) else base
        elif people:
            best = max(people, key=lambda k: names.compatibility(row, people[k]))
            if names.compatibility(row, people[best]) >= 0.80:
                key = best
            else:
                key = variant(base, row) if any(names.conflict(row, p) for p in people.values()) else base
        else:
            key = base
        kept = people.setdefault(key, dict(row))
        for k in FIELDS:
            kept[k] = kept[k] or row[k]
        out.append((r["id"], key))
    return pd.DataFrame(out, columns=["id", "key"])


def resolve(incoming: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(id, key) of records (id, name_key, profile fields); `stored` has the same columns, keys perhaps with a variant mark."""
    ship(incoming.sparkSession)
    rows = incoming.select("id", "name_key", *FIELDS)
    if stored is None:
        return rows.groupBy("name_key").applyInPandas(lambda r: resolve_block(r), "id long, key string")
    # Under names of their own, as both sides may come from one table.
    kept = stored.select(F.split_part("name_key", F.lit("::"), F.lit(1)).alias("base"), *[F.col(c).alias(f"stored_{c}") for c in ("id", "name_key", *FIELDS)])
    found = rows.groupBy("name_key").cogroup(kept.groupBy("base")).applyInPandas(resolve_block, "id long, key string")
    new = rows.select("name_key").distinct().join(kept.select(F.col("base").alias("name_key")), "name_key", "left_anti")
    near = best_match(new.select(F.col("name_key").alias("id"), "name_key"), stored).select(F.col("id").alias("name_key"), "match")
    near = near.join(stored.select(F.col("id").alias("match"), F.col("name_key").alias("stored_key")), "match").select("name_key", "stored_key")
    named = rows.select("id", "name_key").join(near, "name_key")
    return found.join(named.select("id", "stored_key"), "id", "left").select("id", F.coalesce("stored_key", "key").alias("key"))


def new_aliases(resolved: DataFrame, stored: DataFrame) -> DataFrame:
    """(key, alias, alias_key) to add: of resolved (id, key, full_name, aliases), each alias key once, the first id's.

    Left out: empty aliases, a record's own name, and alias keys that `stored` (alias_key) has; for ASCII names.
    """
    each = resolved.select("id", "key", names.name_key_ascii(F.col("full_name")).alias("own"), F.posexplode("aliases").alias("pos", "alias"))
    keyed = each.withColumn("alias", F.trim("alias")).withColumn("alias_key", names.name_key_ascii(F.col("alias"))).where("alias_key != '' and alias_key != own")
    first = keyed.groupBy("alias_key").agg(F.min_by(F.struct("key", "alias"), F.struct("id", "pos")).alias("f"))
    return first.join(stored.select("alias_key").distinct(), "alias_key", "left_anti").select("f.key", "f.alias", "alias_key")


def best_match(unknown: DataFrame, stored: DataFrame, least: float = 88.0) -> DataFrame:
    """(id, match, score): the best stored name of each unknown one, ties to the smaller id.

    Each name is looked up once and stored names by their smallest id.  Names of one
    first initial meet, the stored ones dealt over cells; see linkage.likely and
    linkage.room for what is scored.
    """
    wanted, kept = linkage.representatives(unknown), linkage.representatives(stored)
    u = linkage.prepared(wanted, "own", "id").withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(linkage.CELLS - 1))))
    s = linkage.prepared(kept, "cell", "id")
    n = linkage.spread(unknown)
    l, r = u.repartition(n, "block", "cell").alias("l"), s.repartition(n, "block", "cell").hint("merge").alias("r")
    both = l.join(r, (F.col("l.block") == F.col("r.block")) & (F.col("l.cell") == F.col("r.cell")) & linkage.likely("l", "r", least) & linkage.room("l", "r", least))
    scored = both.select(F.col("l.name_key").alias("name_key"), F.col("r.id").alias("match"), names.identity_udf("l.name_key", "r.name_key").alias("score")).where(F.col("score") >= least)
    best = scored.groupBy("name_key").agg(F.max(F.struct("score", (-F.col("match")).alias("m"))).alias("b"))
    return unknown.select("id", "name_key").join(best, "name_key").select("id", (-F.col("b.m")).alias("match"), F.col("b.score").alias("score"))
