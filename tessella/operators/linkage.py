"""Record linkage: blocked fuzzy pairs, and the order-exact merge.

Only names of one first initial can match, so pairs meet by an equi-join on it, dealt
over cells so that a frequent initial is many tasks.  Records of one name are compared
with other names once, by the smallest id.  A pair is scored in Python only if two
bounds computed on the JVM leave room for the score: insertions and deletions are never
fewer than the letters that one text has alone, nor than Levenshtein's edits, so every
part of the score is at most what these allow.

Merging is order-dependent (a survivor's filled fields can enable a later merge), so
it is a fold over the candidate pairs, run per group of records that names alone can
connect: names never change in a merge, so groups are independent.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..session import checkpointed, ship

FIELDS = ["designation", "affiliation", "location", "specialty", "profile_url"]


CELLS = 12


def prepared(people: DataFrame, cells: str, *extra: str) -> DataFrame:
    """Names of two tokens or more with the columns that the bounds need."""
    t = F.split("name_key", " ")
    p = people.where(F.size(t) >= 2)
    columns = [F.substring("name_key", 1, 1).alias("block"), F.pmod(F.xxhash64("id"), F.lit(CELLS)).alias(cells), F.sort_array(F.array_distinct(F.filter(t, lambda x: x != ""))).alias("tokens"), F.element_at(t, 1).alias("first"), F.element_at(t, -1).alias("last")]
    p = p.select(*extra, "name_key", *columns)
    return p.withColumns({f"{c}_bits": letters(F.col(c)) for c in ("name_key", "first", "last")})


def letters(text: Column) -> Column:
    """The distinct printable ASCII characters of a text but blanks as a set of 64 bits; characters of equal code modulo 64 share one."""
    bit = lambda c: F.when(F.ascii(c).between(33, 126), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(64)))).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0).cast("long"), lambda a, c: a.bitwiseOR(bit(c)))


def likely(l: str, r: str, least: float) -> Column:
    """False only for pairs whose score is surely below `least`, by lengths and letters alone.

    A character that only one text has is an insertion or a deletion; the part on tokens counts in full.
    """
    def near(c: str) -> Column:
        x, y = F.col(f"{l}.{c}"), F.col(f"{r}.{c}")
        return F.lit(1.0) - F.bit_count(F.col(f"{l}.{c}_bits").bitwiseXOR(F.col(f"{r}.{c}_bits"))) / F.greatest(F.length(x) + F.length(y), F.lit(1))

    return 45 + 20 * near("name_key") + 20 * near("first") + 15 * near("last") >= least - 1e-6


def spread(df: DataFrame) -> int:
    s = df.sparkSession
    return max(4 * s.sparkContext.defaultParallelism, int(s.conf.get("spark.sql.shuffle.partitions")))


def room(l: str, r: str, least: float) -> Column:
    """False only for pairs whose identity score is surely below `least`."""
    near = lambda a, b: F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a) + F.length(b), F.lit(1))
    part = lambda c: near(F.col(f"{l}.{c}"), F.col(f"{r}.{c}"))
    rest = 20 * part("name_key") + 20 * part("first") + 15 * part("last")
    x, y = F.col(f"{l}.tokens"), F.col(f"{r}.tokens")
    both = F.array_join(F.array_intersect(x, y), " ")
    # Tokens are sorted. The shared ones stand first in both joined forms, so their ratio to each is one of lengths alone.
    joined = lambda a, b: F.concat_ws(" ", F.array_intersect(a, b), F.array_except(a, b))
    p, q = joined(x, y), joined(y, x)
    share = lambda w: 2 * F.length(both) / (F.length(both) + F.length(w))
    whole = F.when((both != "") & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)), 1.0).otherwise(F.greatest(near(p, q), F.when(both != "", F.greatest(share(p), share(q))).otherwise(0.0)))
    slack = 1e-6
    return F.when(45 + rest < least - slack, False).otherwise(45 * whole + rest >= least - slack)


def representatives(people: DataFrame) -> DataFrame:
    """(id, name_key, n): each name that can match (two tokens or more), its smallest id and its number of records."""
    ship(people.sparkSession)
    named = people.where(F.size(F.split("name_key", " ")) >= 2).groupBy("name_key").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    return named.where(names.identity_udf("name_key", "name_key") > 0)


def name_pairs(names_: DataFrame, least: float = 88.0) -> DataFrame:
    """(a, b, score) with a < b of different names (id, name_key) that score at least `least`.

    A pair meets in the one task of its two cells.
    """
    ship(names_.sparkSession)
    p = prepared(names_, "cell", "id")
    dealt = p.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1)))).withColumn("task", F.struct("block", F.least("cell", "other").alias("lo"), F.greatest("cell", "other").alias("hi")))
    # Few bytes are much work here: a fixed number of partitions, which adaptive execution leaves alone.
    dealt = dealt.repartition(spread(names_), "task")
    l, r = dealt.alias("l"), dealt.hint("merge").alias("r")
    own = (F.least("l.cell", "r.cell") == F.col("l.task.lo")) & (F.greatest("l.cell", "r.cell") == F.col("l.task.hi"))
    both = l.join(r, (F.col("l.task") == F.col("r.task")) & (F.col("l.id") < F.col("r.id")) & own & likely("l", "r", least) & room("l", "r", least))
    return both.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), names.identity_udf("l.name_key", "r.name_key").alias("score")).where(F.col("score") >= least)


def class_pairs(people: DataFrame, least: float = 88.0) -> DataFrame:
    """(a, b, score, copy): similar names as pairs of their smallest ids, and for every other record its name's smallest id (copy, 100).

    Records of one name are compared with others once, so the rows are those of the
    records and of the pairs of different names; candidate_pairs has them expanded.
    """
    reps = representatives(people)
    own = people.select("id", "name_key").join(reps.select("name_key", F.col("id").alias("a")), "name_key").where("id != a")
    copies = own.select("a", F.col("id").alias("b"), F.lit(100.0).alias("score"), F.lit(True).alias("copy"))
    return name_pairs(reps, least).withColumn("copy", F.lit(False)).unionByName(copies)


def candidate_pairs(people: DataFrame, least: float = 88.0) -> DataFrame:
    """(a, b, score) with a < b of records (id, name_key) whose names score at least `least`.

    Names are compared once; the result has every pair of records, the square of a name's copies.
    """
    reps = representatives(people)
    member = people.select("id", "name_key").join(reps.select("name_key", F.col("id").alias("rep")), "name_key").select("rep", "id")
    l, r = member.select(F.col("rep").alias("x"), F.col("id").alias("a")), member.select(F.col("rep").alias("y"), F.col("id").alias("b"))
    near = name_pairs(reps, least).select(F.col("a").alias("x"), F.col("b").alias("y"), "score")
    apart = near.join(l, "x").join(r, "y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")
    same = l.join(r, F.col("x") == F.col("y")).where("a < b").select("a", "b", F.lit(100.0).alias("score")).where(F.lit(least <= 100))
    return apart.unionByName(same)


def groups(pairs: DataFrame) -> DataFrame:
    """(id, grp): connected records, grp the smallest id.

    Each round takes the least label of the neighbours and then that label's own label,
    so rounds grow with the logarithm of the longest path; lineage is cut by checkpoints.
    """
    edges = checkpointed(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    label = checkpointed(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("grp")))
    while True:
        least = edges.join(label.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("grp").alias("m"))
        after = label.join(least.withColumnRenamed("a", "id"), "id").select("id", F.col("grp").alias("was"), F.least("grp", "m").alias("grp"))
        jump = label.select(F.col("id").alias("grp"), F.col("grp").alias("up"))
        after = checkpointed(after.join(jump, "grp", "left").select("id", "was", F.least("grp", F.coalesce("up", "grp")).alias("grp")))
        moved = not after.where("grp != was").isEmpty()
        label = after.select("id", "grp")
        if not moved:
            return label


def _fold(rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """Merges the records of a group pair by pair in ascending order of ids; target is the survivor's id.

    rows: the records of one name and profile as one row with their ascending ids;
    pairs: similar names.  A survivor changes only where a gap is filled, and a record
    that was not a survivor yet is as it came, so whole rows merge at once up to the
    next record that fills a gap.
    """
    rows = rows.reset_index(drop=True)
    profiles = [tuple(None if pd.isna(v) else v for v in p) for p in rows[FIELDS].itertuples(index=False)]
    ids = [np.asarray(x, dtype=np.int64) for x in rows["ids"]]
    alive = [np.ones(len(x), dtype=bool) for x in ids]
    target = [x.copy() for x in ids]
    of_name: dict[int, list[int]] = {}
    for c, name in enumerate(rows["name"]):
        of_name.setdefault(name, []).append(c)
    near = {name: [name] for name in of_name}
    for a, b in pairs[["a", "b"]].itertuples(index=False):
        near[a].append(b)
        near[b].append(a)

    @functools.cache
    def merges(x: tuple, y: tuple) -> bool:
        p, q = dict(zip(FIELDS, x, strict=True)), dict(zip(FIELDS, y, strict=True))
        return not names.conflict(p, q) and names.signals(p, q) >= 2

    def after(c: int, place: int) -> np.ndarray:
        """Places of a row's living records with an id above `place`."""
        start = np.searchsorted(ids[c], place, side="right")
        return start + np.flatnonzero(alive[c][start:])

    # A row whose first survivor kept its profile has taken all that equal records could take.
    settled: set[int] = set()
    every = sorted((i, c, n) for c, x in enumerate(ids) for n, i in enumerate(x.tolist()))
    for i, c, n in every:
        if c in settled or not alive[c][n]:
            continue
        state, place = profiles[c], i
        while True:
            fits = [o for name in near[rows["name"][c]] for o in of_name[name] if merges(state, profiles[o])]
            left = [(o, k) for o in fits if len(k := after(o, place))]
            gaps = [f for f, v in enumerate(state) if not v]
            fills = [ids[o][k[0]] for o, k in left if any(profiles[o][f] for f in gaps)]
            upto = min(fills, default=None)
            for o, k in left:
                k = k if upto is None else k[ids[o][k] <= upto]
                target[o][k], alive[o][k] = i, False
                if upto is not None and len(k) and ids[o][k[-1]] == upto:
                    filler = profiles[o]
            if upto is None:
                break
            state, place = tuple(v or w for v, w in zip(state, filler, strict=True)), upto
        if state == profiles[c]:
            settled.add(c)
    return pd.DataFrame({"id": np.concatenate(ids), "target": np.concatenate(target)})


def merge_close(people: DataFrame) -> DataFrame:
    """(id, target) of every record that takes part in a candidate pair.

    Equal names with equal profiles travel and merge as one row, and only different names are compared.
    """
    reps = checkpointed(representatives(people))
    pairs = checkpointed(name_pairs(reps))
    grp = reps.join(groups(pairs), "id", "left").where("grp IS NOT NULL OR n > 1").select("name_key", F.col("id").alias("name"), F.coalesce("grp", "id").alias("grp"))
    rows = people.select("id", "name_key", *FIELDS).join(grp, "name_key").groupBy("grp", "name", *FIELDS).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    linked = pairs.select("a", "b").join(grp.select(F.col("name").alias("a"), F.col("grp").alias("of")), "a")
    return rows.groupBy("grp").cogroup(linked.groupBy("of")).applyInPandas(_fold, "id long, target long")


def rekey(rows: DataFrame, column: str, mapping: DataFrame, unique: list[str]) -> DataFrame:
    """rows with merged ids replaced; rows that become equal in `unique` (nulls equal) collapse."""
    m = mapping.select(F.col("id").alias(column), F.col("target").alias("_t"))
    return rows.join(m, column, "left").withColumn(column, F.coalesce("_t", column)).drop("_t").dropDuplicates(unique)
