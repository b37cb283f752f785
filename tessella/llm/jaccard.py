"""Exact n-gram Jaccard join by universe partitioning (pigeonhole over segments).

A document's set is its distinct 5-word shingles.  Sets are put in size bands of
ratio 4/3; a set is linked only with sets of its own or a neighbouring band.  For
a band the hash universe is cut into m segments, m a little over the largest
symmetric difference H that a link allows, plus one.  If |X ^ Y| <= H, then among
any segments whose allotments sum to more than H one has a difference below its
allotment: allotment 1 asks for equal segments, 2 for segments equal after at most
one deletion, 0 leaves a segment out.

Cost-based allocation: a segment key that more than ``hot`` sets share is left out
(allotment 0).  A set whose remaining non-empty segments still exceed H needs
nothing else.  The others ("short" sets) are indexed again with the one-deletion
neighbourhoods of all their segments; a set that even this leaves short is indexed
on a finer cut.

A key's members meet its head, the member of the smallest hash.  All keys of one head
are one list, so a group that shares hundreds of keys is listed once, not once a key.
Pairs of head and member come first.  A list whose members then lie in different
components is compared across these in rounds: each component offers its closest
few pairs by sketch, links merge components, and the next round looks at what is left;
the last round leaves nothing out.  So no component is lost and no group is expanded
into all its pairs.  Large lists are dealt over tasks in blocks of members.  Pairs
whose parity sketches differ in more bits than a link allows differences are dropped;
all others are verified on the sets.  ``similar_pairs`` skips the components and
gives every link between different sets.

Keys travel packed in binary blocks per (band, slice): four bytes a key, and twelve
for a set in a slice.  Equal sets are one node throughout.

Defined results: texts without words (null and empty ones too) have an empty set,
0 shingles, no links and their own doc_id as component; null doc_id rows link like
others, and a component's id is its smallest non-null doc_id; repeated rows are
equal sets; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Slab, discard, fresh, materialize, mix, narrow_batches, slabs, word_hashes

SHINGLE = 5
NUM, DEN = 3, 4  # similarity of at least 3/4
HOT = 24
LONG = 48  # longer lists are compared one by one
BLOCK = 1000  # members of a block of a large list
ROUNDS = (16, 256, None)  # closest pairs that a component offers in a round
SLACK = 1.35
BANDS = [1]
while BANDS[-1] < 1 << 40:
    BANDS.append(BANDS[-1] * DEN // NUM + 1)
_BANDS = np.array(BANDS)


def largest_difference(x: np.ndarray | int) -> np.ndarray | int:
    """Largest |X ^ Y| of a link between a set of x and one of at least x elements."""
    return (x + x * DEN // NUM) * (DEN - NUM) // (DEN + NUM)


_H_TOP = largest_difference(_BANDS[1:] - 1)
SEGMENTS = np.where(_H_TOP == 0, 1, np.ceil(SLACK * (_H_TOP + 1))).astype(np.int64)


def shingle_sets(slab: Slab) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, before = word_hashes(slab)
    n = len(h)
    step = U64(0xD6E8FEB86659FD93)
    acc = h.copy()
    for j in range(1, SHINGLE):
        acc[: n - j] = acc[: n - j] * step + h[j:]
    full = mix(acc)
    out = []
    for i in range(len(before) - 1):
        a, b = int(before[i]), int(before[i + 1])
        if b - a >= SHINGLE:
            out.append(np.unique(full[a : b - SHINGLE + 1]))
        elif b > a:
            v = np.array([b - a], U64)
            for w in h[a:b]:
                v = mix(v * step + w)
            out.append(v)
        else:
            out.append(np.zeros(0, U64))
    return out




def set_hash(s: np.ndarray) -> int:
    """Order-free hash of a set, 0 only for the empty set."""
    if not len(s):
        return 0
    return int(np.array([np.sum(mix(s ^ U64(0xA5A5A5A5A5A5A5A5)), dtype=U64) + U64(len(s))], U64).view(np.int64)[0]) or 1


def cut(s: np.ndarray, band: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Non-empty segments of a sorted set: numbers, first positions, sizes and sums of element hashes."""
    seg = ((s >> U64(32)) * U64(m)) >> U64(32)
    first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    e = mix(s + U64(0x632BE59BD9B4E019))
    return seg[first], first, np.diff(np.append(first, len(s))), np.add.reduceat(e, first)


def segment_keys(seg: np.ndarray, sums: np.ndarray, band: int, m: int) -> np.ndarray:
    return mix(sums + mix(seg * U64(0x9E3779B97F4A7C15) + U64((band << 40) + m)))


def roles(n: int) -> list[tuple[int, int]]:
    """(band, least sum of allotments) in which a set of n elements is indexed: as the smaller or equal side, and as the larger."""
    b = int(np.searchsorted(_BANDS, n, side="right")) - 1
    out = [(b, int(largest_difference(n)) + 1)]
    if b and n <= (BANDS[b] - 1) * DEN // NUM:
        out.append((b - 1, 2 * n * (DEN - NUM) // (DEN + NUM) + 1))
    return [(b, need) for b, need in out if _H_TOP[b] > 0]


_BLOCK = "band int, slice int, docs binary, slack binary, size binary, short binary, keys binary"


def _pack(entries: dict[int, list], slices: dict[int, int], short: dict[int, set]) -> Iterator[pa.RecordBatch]:
    """Blocks of one slab; entries: band -> [(set hash, slack, keys)]. A block's keys stand set by set, size has their numbers."""
    cols: list[list] = [[] for _ in range(7)]
    for band, rows in entries.items():
        keys = np.concatenate([k for _, _, k in rows])
        ref = np.repeat(np.arange(len(rows), dtype=np.uint32), [len(k) for _, _, k in rows])
        part = (keys % U64(slices.get(band, 1))).astype(np.int64)
        o = np.argsort(part, kind="stable")
        keys, ref, part = (keys[o] >> U64(32)).astype(np.uint32), ref[o], part[o]
        docs, slack = np.array([d for d, _, _ in rows], np.int64), np.array([s for _, s, _ in rows], np.int32)
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        for k, (i, j) in enumerate(zip(at, [*at[1:], len(part)], strict=True)):
            used, size = np.unique(ref[i:j], return_counts=True)
            row = (band, int(part[i]), docs[used].tobytes(), np.clip(slack[used], -32768, 32767).astype(np.int16).tobytes(), size.astype(np.uint16 if size.max() < 1 << 16 else np.uint32).tobytes(), np.array(sorted(short.get(band, ())) if k == 0 else [], np.int64).tobytes(), keys[i:j].tobytes())
            for c, v in zip(cols, row, strict=True):
                c.append(v)
    if cols[0]:
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _BLOCK.split(", ")])


def _index(slices: dict[int, int]):
    """Exact segment keys of each set, in its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch.column(0), 2 << 20):
                entries, short, seen = {}, {}, set()
                for s in shingle_sets(slab):
                    sh = set_hash(s)
                    if sh in seen or not len(s):
                        continue
                    seen.add(sh)
                    for band, need in roles(len(s)):
                        m = int(SEGMENTS[band])
                        seg, _, _, sums = cut(s, band, m)
                        entries.setdefault(band, []).append((sh, len(seg) - need, segment_keys(seg, sums, band, m)))
                        if len(seg) < need:
                            short.setdefault(band, set()).add(sh)
                yield from _pack(entries, slices, short)

    return run


def _index_short(slices: dict[int, int]):
    """Rows (text, bands): keys of all segments and of their one-deletion neighbourhoods; a finer cut where these do not suffice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = batch.column(1).to_pylist()
            for slab in slabs(batch.column(0), 2 << 20):
                entries: dict[int, list] = {}
                for i, s in enumerate(shingle_sets(slab)):
                    sh, e = set_hash(s), mix(s + U64(0x632BE59BD9B4E019))
                    for band, need in roles(len(s)):
                        if band not in bands[slab.lo + i]:
                            continue
                        m = int(SEGMENTS[band])
                        seg, _, size, sums = cut(s, band, m)
                        each = np.repeat(np.arange(len(seg)), size)
                        more = size[each] > 1  # a lone element is not deleted: the empty segment says nothing
                        less = segment_keys(seg[each[more]], sums[each[more]] - e[more], band, m)
                        keys = [segment_keys(seg, sums, band, m), less]
                        if len(seg) + int((size > 1).sum()) < need:
                            fine = 16 * m
                            seg, _, _, sums = cut(s, band, fine)
                            keys.append(segment_keys(seg, sums, band, fine))
                        entries.setdefault(band, []).append((sh, 0, np.concatenate(keys)))
                yield from _pack(entries, slices, {})

    return run


_FOUND = "kind int, x long, y long, z long, w long"
PAIR, HOT_COUNT, SHORT = range(3)


def _meet(hot: int | None):
    """Each set that shares a key of a block group, with the key's head; keys of more than ``hot`` sets are counted instead."""

    def run(group: pa.Table) -> pa.Table:
        out: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        band = group["band"][0].as_py()
        keys, docs, slack, short = [], [], [], []
        for d, s, n, f, k in zip(*[group[c].to_pylist() for c in ("docs", "slack", "size", "short", "keys")], strict=True):
            d = np.frombuffer(d, np.int64)
            n = np.frombuffer(n, np.uint16 if len(n) == 2 * len(d) else np.uint32)
            keys.append(np.frombuffer(k, np.uint32))
            docs.append(np.repeat(d, n))
            slack.append(np.repeat(np.frombuffer(s, np.int16), n))
            short.append(np.frombuffer(f, np.int64))
        key, doc, room = np.concatenate(keys), np.concatenate(docs), np.concatenate(slack)
        del keys, docs, slack
        o = np.argsort(key)
        key = key[o]
        again = np.zeros(len(key) + 1, bool)
        again[1:-1] = key[1:] == key[:-1]
        some = again[1:] | again[:-1]
        key, o = key[some], o[some]
        doc, room = doc[o], room[o]
        o = np.lexsort((doc, key))
        key, doc, room = key[o], doc[o], room[o]
        if len(key):
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
            key, doc, room = key[new], doc[new], room[new]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(first, len(key)))
            big = size > (len(key) if hot is None else hot)
            who, inv = np.unique(doc, return_inverse=True)
            star = np.arange(len(key)) != np.repeat(first, size)
            star &= ~np.repeat(big, size)
            p = np.unique(np.repeat(inv[first], size)[star] * len(who) + inv[star])
            none = np.zeros(len(p))
            out.append((PAIR, who[p // len(who)], who[p % len(who)], none, none))
            if big.any():
                mem = np.repeat(big, size)
                cnt = np.bincount(inv[mem], minlength=len(who))
                room_of = np.zeros(len(who), np.int64)
                room_of[inv] = room
                many = np.flatnonzero(cnt)
                out.append((HOT_COUNT, who[many], np.full(len(many), band), cnt[many], room_of[many]))
        lone = np.unique(np.concatenate(short))
        out.append((SHORT, lone, np.full(len(lone), band), np.zeros(len(lone)), np.zeros(len(lone))))
        return pa.table({"kind": np.concatenate([np.full(len(t[1]), t[0], np.int32) for t in out]), **{c: np.concatenate([np.asarray(t[i + 1], np.int64) for t in out]) for i, c in enumerate("xyzw")}})

    return run


def sketch(s: np.ndarray) -> bytes:
    """Parities of the set's elements in at least two buckets an element: differing bits never outnumber |X ^ Y|."""
    m = 1 << min(16, max(8, int(2 * len(s)).bit_length()))
    return np.packbits(np.bincount((s & U64(m - 1)).astype(np.int64), minlength=m) & 1).tobytes()


class Sketches:
    """Sketches by width, compared in blocks."""

    def __init__(self, marks: list[bytes]) -> None:
        self.width = np.array([len(m) for m in marks], np.int64)
        self.row = np.zeros(len(marks), np.int64)
        self.rows: dict[int, np.ndarray] = {}
        for w in np.unique(self.width):
            at = np.flatnonzero(self.width == w)
            self.row[at] = np.arange(len(at))
            self.rows[int(w)] = np.frombuffer(b"".join(marks[k] for k in at), U64).reshape(len(at), -1)

    def distance(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Differing bits of the sketches of pairs (a, b) over the differences that a link allows; n: the sum of the two sizes.

        Above 1 a link is ruled out.
        """
        out = np.zeros(len(n))
        kind = self.width[a] << 20 | self.width[b]
        for k in np.unique(kind):
            wa, wb = int(k >> 20), int(k & ((1 << 20) - 1))
            rows, w = np.flatnonzero(kind == k), min(wa, wb) // 8
            step = max(1, (1 << 21) // max(wa, wb) * 8)
            for i in range(0, len(rows), step):
                at = rows[i : i + step]
                x, y = (m[r].reshape(len(at), -1, w) for m, r in ((self.rows[wa], self.row[a[at]]), (self.rows[wb], self.row[b[at]])))
                x, y = (np.bitwise_xor.reduce(v, axis=1) if v.shape[1] > 1 else v[:, 0] for v in (x, y))
                allowed = n[at] * (DEN - NUM) // (DEN + NUM)
                differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                out[at] = np.where(differ <= allowed, differ / np.maximum(allowed, 1), 2.0)
        return out


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (x, y, sizes, sketches): the pairs that sizes and sketches leave."""
    for batch in batches:
        nx, ny = np.asarray(batch.column(2)), np.asarray(batch.column(3))
        fits = np.flatnonzero(np.minimum(nx, ny) * DEN >= np.maximum(nx, ny) * NUM)
        some = batch.take(pa.array(fits))
        k = np.arange(len(fits))
        ok = Sketches(some.column(4).to_pylist() + some.column(5).to_pylist()).distance(k, k + len(fits), (nx + ny)[fits]) <= 1 if len(fits) else np.zeros(0, bool)
        yield some.select([0, 1]).filter(pa.array(ok))


_CLOSE = "x long, y long, head long"


def _cross(most: int | None):
    """Rows (key, head, sh, label) of lists and (sh, n, sketch) of sets: close pairs of different components.

    A component offers its ``most`` closest pairs; a list that has more left gives a row with its head only.
    """

    def run(group: pa.Table) -> pa.Table:
        is_node = np.asarray(group["sketch"].is_valid())
        nodes = group.filter(pa.array(is_node))
        who, n = np.asarray(nodes["sh"]), np.asarray(nodes["n"])
        book, base = Sketches(nodes["sketch"].to_pylist()), len(who)
        o = np.argsort(who)
        rows = group.filter(pa.array(~is_node))
        key, head, label = (np.asarray(rows[c]) for c in ("key", "head", "label"))
        at = o[np.searchsorted(who[o], np.asarray(rows["sh"]))]
        o = np.lexsort((n[at], key))
        key, head, label, at = key[o], head[o], label[o], at[o]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(key)))
        found: list[np.ndarray] = [np.zeros((4, 0))]

        def look(x: np.ndarray, y: np.ndarray) -> None:
            """Pairs of places in the lists: those of different components and fitting sizes."""
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
            fits = np.minimum(n[at[x]], n[at[y]]) * DEN >= np.maximum(n[at[x]], n[at[y]]) * NUM
            x, y = x[fits], y[fits]
            far = book.distance(at[x], at[y], n[at[x]] + n[at[y]])
            ok = far <= 1
            found.append(np.stack([np.minimum(at[x], at[y])[ok] * base + np.maximum(at[x], at[y])[ok], x[ok], y[ok], far[ok] * 1e9]).astype(np.int64))

        for k in np.unique(size[size <= LONG]):
            i, j = np.triu_indices(int(k), 1)
            lists = first[size == k]
            step = max(1, 1_000_000 // max(1, len(i)))
            for c in range(0, len(lists) if len(i) else 0, step):
                look((lists[c : c + step, None] + i).ravel(), (lists[c : c + step, None] + j).ravel())
        # The members of a long list stand in order of size: each meets those that sizes allow.
        for a, k in zip(first[size > LONG].tolist(), size[size > LONG].tolist(), strict=True):
            sizes = n[at[a : a + k]]
            for i in range(0, k, 500):
                end = min(i + 500, k)
                last = int(np.searchsorted(sizes, sizes[end - 1] * DEN // NUM, side="right"))
                for j in range(i, last, 2000):
                    x, y = np.meshgrid(np.arange(a + i, a + end), np.arange(a + j, a + min(j + 2000, last)), indexing="ij")
                    once = x < y
                    look(x[once], y[once])
        code, x, y, far = np.concatenate(found, axis=1).astype(np.int64)
        _, one = np.unique(code, return_index=True)
        x, y, far = x[one], y[one], far[one]
        keep = np.ones(len(x), bool)
        if most is not None and len(x):
            side, pair = np.concatenate([label[x], label[y]]), np.tile(np.arange(len(x)), 2)
            o = np.lexsort((far[pair], side))
            start = np.flatnonzero(np.concatenate([[True], side[o][1:] != side[o][:-1]]))
            place = np.arange(len(o)) - np.repeat(start, np.diff(np.append(start, len(o))))
            keep[:] = False
            keep[pair[o[place < most]]] = True
        left = np.unique(head[x[~keep]])
        x, y = who[at[x[keep]]], who[at[y[keep]]]
        gone = np.zeros(len(left), bool)
        return pa.table({"x": np.concatenate([np.minimum(x, y), left]), "y": pa.array(np.concatenate([np.maximum(x, y), left])), "head": pa.array(np.concatenate([np.zeros(len(x), np.int64), left]), mask=np.concatenate([np.ones(len(x), bool), gone]))})

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, sh, marks = [], [], []
        for slab in slabs(batch.column(1)):
            for s in shingle_sets(slab):
                n.append(len(s))
                sh.append(set_hash(s))
                marks.append(sketch(s))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sh, pa.int64()), batch.column(2), pa.array(marks, pa.binary())], ["doc_id", "n", "sh", "th", "sketch"])


def _verify(group: pa.Table) -> pa.Table:
    """Of the texts of a hub (role 0) and its partners, the partners that are linked with it."""
    role, own, hub = np.asarray(group["role"]), np.asarray(group["sh"]), np.asarray(group["hub"])
    sets = [s for slab in slabs(group["text"]) for s in shingle_sets(slab)]
    x, y = [], []
    hubs = {int(hub[i]): sets[i] for i in np.flatnonzero(role == 0)}
    for i in np.flatnonzero(role == 1):
        a, b = hubs[int(hub[i])], sets[i]
        small, large = (a, b) if len(a) <= len(b) else (b, a)
        k = np.minimum(np.searchsorted(large, small), len(large) - 1)
        both = int((large[k] == small).sum())
        if DEN * both >= NUM * (len(a) + len(b) - both):
            x.append(hub[i])
            y.append(own[i])
    return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})


def verify(pairs: DataFrame, texts: DataFrame, per_task: int = 500) -> DataFrame:
    """Links among pairs (x, y) of set hashes; texts: (sh, text). A hub's partners are dealt out in parts of about per_task."""
    fan = pairs.groupBy("x").agg(F.count("*").alias("_n"))
    dealt = materialize(pairs.join(fan, "x").select("x", "y", F.pmod(F.xxhash64("y"), F.ceil(F.col("_n") / per_task)).alias("part")), "jaccard-pairs", small=True)
    ask = dealt.select(F.col("x").alias("hub"), "part", F.lit(1).alias("role"), F.col("y").alias("sh"))
    hubs = dealt.select(F.col("x").alias("hub"), "part").distinct().select("hub", "part", F.lit(0).alias("role"), F.col("hub").alias("sh"))
    rows = ask.unionByName(hubs).join(texts, "sh")
    links = materialize(rows.groupBy("hub", "part").applyInArrow(_verify, "x long, y long"), "jaccard-links")
    discard(dealt)
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node, label the component's smallest node: alternating large-star and small-star."""
    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialize(links.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).where("a != b").distinct(), "cc", small=True)
    was = state(edges)
    while was[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written first, the minima are joined by an exchange of their own, which adaptive execution can split at a hub.
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc-low", small=True)
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large, "cc-large", small=True)
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "cc-least", small=True)
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        after = materialize(small, "cc", small=True)
        now = state(after)
        discard(edges, low, large, least)
        edges = after
        if now == was:
            break
        was = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


FILTER = 1 << 24  # bits of the filter of texts: at most FILTER / 64 rows are broadcast


class _Candidates:
    """Distinct sets of the documents and the lists of those that may be linked."""

    def __init__(self, documents: DataFrame, hot: int, slice_keys: int) -> None:
        narrow_batches(documents.sparkSession)
        self.docs = docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
        self.info = materialize(docs.select("doc_id", "text", "th").mapInArrow(_sets, "doc_id long, n long, sh long, th long, sketch binary"), "jaccard-sets")
        self.nodes = nodes = materialize(self.info.where("n > 0").groupBy("sh").agg(F.min("doc_id").alias("low"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("rep"), F.max("n").alias("n"), F.any_value("sketch").alias("sketch")), "jaccard-nodes")
        # Slices of a band follow the number of its keys: one row a band.
        width = {int(r["n"]): int(r["c"]) for r in nodes.groupBy(F.floor(F.log(DEN / NUM, F.col("n"))).alias("n")).agg(F.sum("n").alias("c")).collect()}
        per_band: dict[int, int] = {}
        for level, c in width.items():
            for b, _ in roles(int((4 / 3) ** level) + 1):
                per_band[b] = per_band.get(b, 0) + c // 2
        top = max(per_band, default=0)
        slices = {b: -(-sum(per_band.get(b + d, 0) for d in (-1, 0, 1)) // slice_keys) or 1 for b in range(top + 3)}

        def meet(blocks: DataFrame, hot: int | None, name: str) -> DataFrame:
            return materialize(blocks.groupBy("band", "slice").applyInArrow(_meet(hot), _FOUND), name)

        met = meet(docs.select("text").mapInArrow(_index(slices), _BLOCK), hot, "jaccard-met")
        counts = met.where(F.col("kind") == HOT_COUNT).groupBy("x", "y").agg(F.sum("z").alias("z"), F.min("w").alias("w")).where("z > w").select("x", "y")
        short = materialize(counts.unionByName(met.where(F.col("kind") == SHORT).select("x", "y")).distinct().select(F.col("x").alias("sh"), F.col("y").alias("band")), "jaccard-short", small=True)
        texts = self.texts(short.select("sh"))
        again = materialize(texts.join(short.groupBy("sh").agg(F.collect_set("band").alias("bands")), "sh").select("text", "bands"), "jaccard-short-texts", small=True)
        met2 = meet(again.mapInArrow(_index_short(slices), _BLOCK), None, "jaccard-met-short")
        #: (head, sh): a head and the sets that share a key with it.
        self.lists = materialize(met.where(F.col("kind") == PAIR).unionByName(met2.where(F.col("kind") == PAIR)).select(F.col("x").alias("head"), F.col("y").alias("sh")).distinct(), "jaccard-lists")
        self.size = nodes.select("sh", "n", "sketch")
        discard(met, met2, short, texts, again)

    def texts(self, need: DataFrame) -> DataFrame:
        """(sh, text) of one document of each set in need. A bitmap of fixed size spares most other texts the shuffle."""
        reps = materialize(self.nodes.join(need.distinct(), "sh", "left_semi").select("sh", F.col("rep.doc_id").alias("_id"), F.col("rep.th").alias("_th")), "jaccard-reps", small=True)
        bit = lambda h: F.pmod(h, F.lit(FILTER))
        words = reps.select(bit("_th").alias("p")).groupBy(F.shiftright("p", 6).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
        some = self.docs.withColumn("p", bit("th")).withColumn("k", F.shiftright("p", 6)).join(F.broadcast(words), "k").where("bit_get(bits, cast(p & 63 as int)) = 1")
        found = some.join(reps.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
        out = materialize(found.select("sh", "text").dropDuplicates(["sh"]), "jaccard-texts")
        discard(reps)
        return out

    def screened(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (x, y) those that sizes and sketches leave."""
        size = self.size
        both = pairs.join(size.select(F.col("sh").alias("x"), F.col("n").alias("nx"), F.col("sketch").alias("sx")), "x").join(size.select(F.col("sh").alias("y"), F.col("n").alias("ny"), F.col("sketch").alias("sy")), "y")
        return both.select("x", "y", "nx", "ny", "sx", "sy").mapInArrow(_screen, "x long, y long")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of pairs (x, y) that are links."""
        texts = self.texts(pairs.select(F.col("x").alias("sh")).unionByName(pairs.select(F.col("y").alias("sh"))))
        out = verify(pairs, texts)
        discard(texts)
        return out

    def across(self, label: DataFrame | None, heads: DataFrame | None, most: int | None) -> DataFrame:
        """Close pairs of sets that share a list and have different labels (without labels: all), and heads of lists with more left."""
        lists = self.lists if heads is None else materialize(self.lists.join(heads, "head", "left_semi"), "jaccard-again", small=True)
        at = lists.unionByName(lists.select("head", F.col("head").alias("sh")).distinct())
        at = at.withColumn("label", F.col("sh")) if label is None else materialize(at.join(label.withColumnRenamed("node", "sh"), "sh", "left").withColumn("label", F.coalesce("label", "sh")), "jaccard-at", small=True)
        at_written = at
        # A list's largest component and its other members are cut into blocks; each block of these meets every block.
        each = at.groupBy("head", "label").agg(F.count("*").alias("c"))
        whole = each.groupBy("head").agg(F.max(F.struct("c", "label")).alias("main"), F.sum("c").alias("c"), F.count("*").alias("labels")).where("labels > 1")
        whole = materialize(whole.select("head", F.col("main.label").alias("main"), F.ceil(F.when(F.col("c") > 2 * BLOCK, (F.col("c") - F.col("main.c")) / BLOCK).otherwise(1)).alias("rest"), F.ceil(F.when(F.col("c") > 2 * BLOCK, F.col("main.c") / BLOCK).otherwise(1)).alias("own")), "jaccard-open", small=True)
        at = at.join(whole, "head")
        is_main = F.col("label") == F.col("main")
        own = F.pmod(F.xxhash64("sh"), F.when(is_main, F.col("own")).otherwise(F.col("rest")))
        # Block numbers: the rest's, then the largest component's. A task is (a, b), a of the rest and a <= b.
        mine = F.when(is_main & (F.col("own") + F.col("rest") > 2), F.col("rest") + own).otherwise(own)
        fellow = F.when(is_main & (F.col("own") + F.col("rest") > 2), F.sequence(F.lit(0).cast("long"), F.col("rest") - 1)).when(F.col("own") + F.col("rest") > 2, F.sequence(F.lit(0).cast("long"), F.col("rest") + F.col("own") - 1)).otherwise(F.array(F.lit(0).cast("long")))
        dealt = at.select("head", "sh", "label", mine.alias("mine"), F.explode(fellow).alias("fellow"))
        dealt = materialize(dealt.select(F.xxhash64("head", F.least("mine", "fellow"), F.greatest("mine", "fellow")).alias("key"), "head", "sh", "label"), "jaccard-dealt", small=True)
        # Each part of the keys gets every sketch it needs once; pairs that sketches rule out never leave it.
        part = F.pmod(F.xxhash64("key"), F.lit(-(-dealt.count() // 50_000) or 1))
        rows = dealt.select(part.alias("part"), "key", "head", "sh", "label", F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("sketch"))
        none = F.lit(None).cast("long")
        marks = rows.select("part", "sh").distinct().join(self.size, "sh").select("part", none.alias("key"), none.alias("head"), "sh", none.alias("label"), "n", "sketch")
        out = materialize(rows.unionByName(marks).groupBy("part").applyInArrow(_cross(most), _CLOSE), "jaccard-cross", small=True)
        discard(whole, dealt, *([] if label is None else [at_written]), *([] if heads is None else [lists]))
        return out


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: only components are joined."""
    side = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    ends = links.join(side("x"), "x", "left").join(side("y"), "y", "left").select(F.coalesce("lx", "x").alias("x"), F.coalesce("ly", "y").alias("y"))
    more = components(ends).select(F.col("node").alias("label"), F.col("label").alias("top"))
    alone = links.select(F.col("x").alias("node")).union(links.select("y")).distinct().join(label, "node", "left_anti").select("node", F.col("node").alias("label"))
    return materialize(label.unionByName(alone).join(more, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "jaccard-labels", small=True)


def near_duplicates(documents: DataFrame, *, hot: int = HOT, slice_keys: int = 1_000_000) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id, set_id (the smallest doc_id with an equal set) of every document, and whether it is its component's first."""
    c = _Candidates(documents, hot, slice_keys)
    star = c.lists.select(F.least("head", "sh").alias("x"), F.greatest("head", "sh").alias("y")).distinct()
    tried = materialize(c.screened(star), "jaccard-tried", small=True)
    label, heads = materialize(components(c.links(tried)), "jaccard-labels", small=True), None
    for most in ROUNDS:
        found = c.across(label, heads, most)
        new = materialize(found.where("head is null").select("x", "y").distinct().hint("merge").join(tried, ["x", "y"], "left_anti"), "jaccard-new", small=True)
        if not new.isEmpty():
            links = c.links(new)
            if not links.isEmpty():
                label = _merged(label, links)
            tried = tried.unionByName(new)
        heads = found.where("head is not null").select("head").distinct()
        if heads.isEmpty():
            break

    named = materialize(c.nodes.select("sh", "low", "rep").join(label.withColumnRenamed("node", "sh"), "sh", "left").withColumn("label", F.coalesce("label", "sh")), "jaccard-named")
    ids = materialize(named.groupBy("label").agg(F.min("low").alias("component_id"), F.min("rep").alias("first")), "jaccard-ids", small=True)
    comp = materialize(named.select("sh", "low", "label").join(ids, "label").select("sh", "low", "component_id", "first"), "jaccard-components")
    discard(c.nodes, c.lists, named, ids)
    is_first = F.col("first").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")))
    return c.info.join(comp, "sh", "left").select("doc_id", "th", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("low", "doc_id").alias("set_id"), is_first.alias("is_first"))


def similar_pairs(documents: DataFrame, *, hot: int = HOT, slice_keys: int = 1_000_000) -> DataFrame:
    """set_a, set_b: every link between two different sets, named by the smallest doc_id of each (see set_id of near_duplicates).

    The result is as large as the number of links, which a group of near copies makes quadratic; near_duplicates does not need them all.
    """
    c = _Candidates(documents, hot, slice_keys)
    links = c.links(materialize(c.across(None, None, None).select("x", "y").distinct(), "jaccard-all", small=True))
    low = lambda side, name: c.nodes.select(F.col("sh").alias(side), F.col("low").alias(name))
    both = links.join(low("x", "a"), "x").join(low("y", "b"), "y")
    return both.select(F.least("a", "b").alias("set_a"), F.greatest("a", "b").alias("set_b"))


def keep_first(documents: DataFrame, **params) -> DataFrame:
    """documents with one row of each component; rows with an empty set all stay, repeated rows collapse."""
    first = near_duplicates(documents, **params).where("is_first").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    first = materialize(first, "jaccard-first")
    names = documents.columns
    h, i, th = fresh(names, "_h", "_id", "_th")
    hashed = documents.withColumn(h, F.xxhash64(F.coalesce("text", F.lit(""))))
    first = first.select(F.col("_id").alias(i), F.col("_th").alias(th))
    return hashed.join(first, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.col(h) == F.col(th))).dropDuplicates([i, th]).select(*names)
