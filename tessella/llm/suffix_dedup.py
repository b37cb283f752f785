"""Removal of repeated 200-byte strings, decided by suffix arrays.

1. Anchors.  The leftmost smallest hash of the 32-byte strings inside a 200-byte
   window is the window's anchor: equal windows have equal anchors at equal places.
   Only anchors whose 32 bytes occur more than once can belong to a repeat.
2. Contexts.  For each such anchor, the bytes its windows cover travel to the shard
   of the anchor's hash; equal contexts are merged with their multiplicity before
   and in the shard.  Anchors with very many occurrences are first cut into narrow
   ranges of window offsets, keyed by the bytes all windows of a range share.
3. Suffix array.  A shard's right-hand contexts, as 8-byte symbols, are put in
   order by linear suffix grouping (``suffix_array``); neighbours' common prefixes
   in bytes then tell, for each offset, which windows agree on their right part,
   and a hash of the left part tells which agree as a whole.
4. Bytes under a repeated window are removed.

``suffix_array`` is the two-phase grouping construction: suffixes are grouped by
their Lyndon prefixes, groups are processed in descending order through
previous-smaller pointers, splitting the groups of the pointed-to suffixes by how
many members point to them; then the groups are emitted in ascending order, each
suffix placing those that it is the next smaller suffix of.  No renaming, no recursion.

Defined results: null and empty texts have no bytes and nothing removed; null
doc_id rows are processed like others; repeated rows count as further occurrences
of their strings; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, U64, Slab, as_long, discard, materialize, mix, narrow_batches, powers, prefix_hash, slabs, span_hash

WIDTH, GRAM = 200, 32
_POS = (1 << 23) - 1  # positions inside a slab piece


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of a sequence of non-negative integers, by Lyndon grouping."""
    n = len(text) + 1  # with an end sign below all others
    if n == 1:
        return []
    s = [x + 1 for x in text]
    s.append(0)
    order = sorted(range(n), key=s.__getitem__)  # members of each group side by side
    place = [0] * n
    group = [0] * n  # a suffix's group, named by the group's first place
    size: dict[int, int] = {}
    last, at = -1, 0
    for k, i in enumerate(order):
        if s[i] != last:
            last, at = s[i], k
            size[at] = 0
        place[i] = k
        group[i] = at
        size[at] += 1
    before = [-1] * n  # nearest earlier suffix of a lower group
    end = n
    while end:
        g = group[order[end - 1]]
        members = order[g:end] if end - g == 1 else sorted(order[g:end])
        pulls: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = before[p]
            before[i] = p
            if p >= 0:
                pulls[p] = pulls.get(p, 0) + 1
        if len(pulls) == 1:
            levels = [list(pulls)]
        else:
            by: dict[int, list[int]] = {}
            for p, c in pulls.items():
                by.setdefault(c, []).append(p)
            levels = [by[c] for c in sorted(by, reverse=True)]
        for ps in levels:
            # The members with most pulls go to the end of their group and form the next one.
            moved: dict[int, int] = {}
            for p in ps:
                h = group[p]
                moved[h] = k = moved.get(h, 0) + 1
                to = h + size[h] - k
                j, q = place[p], order[to]
                order[j], order[to] = q, p
                place[q], place[p] = j, to
            for h, k in moved.items():
                if k < size[h]:
                    new = h + size[h] - k
                    size[h] -= k
                    size[new] = k
                    for t in range(new, new + k):
                        group[order[t]] = new
        end = g
    out = [0] * n
    front = dict.fromkeys(size)
    for g in size:
        front[g] = g
    done = bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    for k in range(n):
        i = out[k]
        stop, p = before[i], i - 1
        while p != stop and p >= 0 and not done[p]:
            g = group[p]
            out[front[g]] = p
            front[g] += 1
            done[p] = 1
            p = before[p]
    return out[1:]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w consecutive values."""
    n = len(x)
    pad = -n % w
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(slab: Slab) -> tuple[np.ndarray, ...]:
    """Of each anchor: text number, hash, position in its text, and its first and last window start."""
    data, offs = slab.data, slab.offs
    if len(data) < WIDTH:
        return tuple(np.zeros(0, t) for t in (np.int64, U64, np.int64, np.int64, np.int64))
    h = prefix_hash(data)
    n = len(data) - GRAM + 1
    i = np.arange(n)
    gram = span_hash(h, i, i + GRAM)
    out = []
    step = _POS - WIDTH
    for a in range(0, len(data) - WIDTH + 1, step):
        b = min(len(data) - WIDTH + 1, a + step)  # windows a .. b - 1
        g = gram[a : b + WIDTH - GRAM]
        low = sliding_min((g >> U64(23)) << U64(23) | np.arange(len(g), dtype=U64), WIDTH - GRAM + 1)
        win = np.arange(a, b)
        doc = np.searchsorted(offs, win, side="right") - 1
        ok = win + WIDTH <= offs[doc + 1]
        at = (low & U64(_POS)).astype(np.int64)[ok] + a
        win, doc = win[ok], doc[ok]
        if len(at):
            new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
            lst = np.append(new[1:], len(at)) - 1
            d = doc[new]
            out.append((d, gram[at[new]], at[new] - offs[d], win[new] - offs[d], win[lst] - offs[d]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else tuple(np.zeros(0, t) for t in (np.int64, U64, np.int64, np.int64, np.int64))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rid = np.asarray(batch.column(0))
        for slab in slabs(batch.column(1)):
            d, h, p, a, b = anchors(slab)
            yield pa.RecordBatch.from_arrays([pa.array(rid[slab.lo + d]), pa.array(as_long(h)), pa.array(p.astype(np.int32)), pa.array((p - a).astype(np.int16)), pa.array((p - b).astype(np.int16))], ["rid", "h", "p", "most", "least"])


NARROW = 8  # window offsets in a range of a frequent anchor
_CONTEXT = "shard long, key long, ctx long, most short, least short, body binary, n long"


def _contexts(shards: int):
    """Rows (text, anchors): merged contexts of the batch. `most` and `least` are bytes from a window's start to the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, list] = {}
            for text, marks in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                for m in marks.as_py():
                    for most, least, key, ctx, body in cuts(raw, m["h"], m["p"], m["most"], m["least"], m["often"]):
                        row = found.get(ctx)
                        if row is None:
                            found[ctx] = [key, most, least, body, 1]
                        else:
                            row[4] += 1
            if found:
                ctx, rows = list(found), list(zip(*found.values(), strict=True))
                key = np.array(rows[0], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key % shards), pa.array(key), pa.array(ctx, pa.int64()), pa.array(rows[1], pa.int16()), pa.array(rows[2], pa.int16()), pa.array(rows[3], pa.binary()), pa.array(rows[4], pa.int64())], [x.split()[0] for x in _CONTEXT.split(", ")])

    return run


def _digest(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def cuts(raw: bytes, h: int, p: int, most: int, least: int, often: bool) -> Iterator[tuple[int, int, int, int, bytes]]:
    """Contexts of an anchor: (most, least, key, identity, bytes from the first window's start to the last one's end)."""
    if not often:
        body = raw[p - most : p - least + WIDTH]
        yield most, least, h, _digest(body, h.to_bytes(8, "little", signed=True), most.to_bytes(2, "little"), least.to_bytes(2, "little")), body
        return
    for low in range(least // NARROW * NARROW, most + 1, NARROW):
        a, b = min(most, low + NARROW - 1), max(least, low)
        body = raw[p - a : p - b + WIDTH]
        shared = raw[p - low : p - low - NARROW + 1 + WIDTH]  # in every window whose offset is in this range
        key = _digest(shared, low.to_bytes(2, "little"))
        yield a, b, key, _digest(body, b"narrow", a.to_bytes(2, "little"), b.to_bytes(2, "little")), body


_REPEATS = "ctx long, most short, least short, lo short, hi short"


def _shard(group: pa.Table) -> pa.Table:
    """Repeated windows of a shard's contexts, as ranges of offsets lo .. hi before the anchor."""
    ctx, first = np.unique(np.asarray(group["ctx"]), return_index=True)
    number = np.zeros(len(ctx), np.int64)
    np.add.at(number, np.searchsorted(ctx, np.asarray(group["ctx"])), np.asarray(group["n"]))
    key, most, least = (np.asarray(group[c])[first].astype(np.int64) for c in ("key", "most", "least"))
    body = [group["body"][int(i)].as_buffer().to_pybytes() for i in first]
    out = [[], [], []]

    def told(i: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        out[0].append(i), out[1].append(lo), out[2].append(hi)

    whole = number > 1  # every window of a context that occurs again occurs again
    told(np.flatnonzero(whole), least[whole], most[whole])
    _, inv, cnt = np.unique(key, return_inverse=True, return_counts=True)
    left = np.flatnonzero(cnt[inv] > 1)
    if len(left) > 1 and not whole[left].all():
        right = [body[i][most[i] :] for i in left]
        size = np.array([len(r) for r in right])
        cell = np.zeros((len(left), WIDTH), np.uint8)
        for k, r in enumerate(right):
            cell[k, : len(r)] = np.frombuffer(r, np.uint8)
        # Different right parts once each: symbols of 8 bytes, order of bytes kept, a sign of its own between strings.
        rows = np.ascontiguousarray(cell).view(">u8").astype(U64)
        one, back = np.unique(rows, axis=0, return_inverse=True)
        back = back.ravel()
        names, sym = np.unique(one, return_inverse=True)
        sym = sym.reshape(one.shape) + 1
        text = np.concatenate([sym, np.zeros((len(one), 1), np.int64)], axis=1).ravel()
        order = np.array(suffix_array(text.tolist()))
        start = order[order % (one.shape[1] + 1) == 0] // (one.shape[1] + 1)
        rank = np.empty(len(one), np.int64)
        rank[start] = np.arange(len(start))
        flat = np.ascontiguousarray(one[start].astype(">u8")).view(np.uint8).reshape(len(one), WIDTH)
        differ = flat[1:] != flat[:-1]
        common = np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), WIDTH)])
        tail = np.zeros((len(left), WIDTH), np.uint8)  # bytes before the anchor, the nearest first
        for k, i in enumerate(left):
            b = np.frombuffer(body[i][: most[i]], np.uint8)[::-1]
            tail[k, : len(b)] = b
        pre = np.concatenate([np.zeros((len(left), 1), U64), np.cumsum(mix(tail.astype(U64) + U64(1)) * powers(WIDTH)[None], axis=1)], axis=1)
        again = np.zeros((len(left), WIDTH), bool)
        for off in range(int(most[left].max()) + 1):
            on = np.flatnonzero((least[left] <= off) & (most[left] >= off))
            if len(on) > 1:
                block = np.cumsum(common < WIDTH - off)[rank[back[on]]]
                same = mix(mix(mix(key[left[on]].astype(U64)) + block.astype(U64)) * U64(BASE) + pre[on, off])
                _, inv, cnt = np.unique(same, return_inverse=True, return_counts=True)
                again[on, off] = cnt[inv] > 1
        again[whole[left]] = False
        edge = np.diff(np.pad(again.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        r, lo = np.nonzero(edge == 1)
        _, hi = np.nonzero(edge == -1)
        told(left[r], lo, hi - 1)
    i, lo, hi = (np.concatenate(x).astype(np.int64) for x in out)
    return pa.table({"ctx": ctx[i], "most": most[i].astype(np.int16), "least": least[i].astype(np.int16), "lo": lo.astype(np.int16), "hi": hi.astype(np.int16)})


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rid, text, anchors): each context of each anchor with its identity."""
    for batch in batches:
        rid, pos, ids = [], [], []
        for r, text, marks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            for m in marks.as_py():
                for _, _, _, ctx, _ in cuts(raw, m["h"], m["p"], m["most"], m["least"], m["often"]):
                    rid.append(r), pos.append(m["p"]), ids.append(ctx)
        yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(pos, pa.int32()), pa.array(ids, pa.int64())], ["rid", "p", "ctx"])


_CUT = "rid long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _cut(keep_text: bool):
    """Rows (rid, text, spans): what remains of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                kept, at, gone, runs = [], 0, 0, 0
                for a, b in sorted((s["a"], s["b"]) for s in spans.as_py()):
                    if a > at or not runs:
                        kept.append(raw[at:a])
                        runs += 1
                        gone += b - a
                        at = b
                    elif b > at:
                        gone += b - at
                        at = b
                rest = b"".join([*kept, raw[at:]])
                for c, v in zip(cols, (gone, runs, hashlib.sha256(rest).hexdigest(), rest.decode(errors="ignore") if keep_text else None), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], [x.split()[0] for x in _CUT.split(", ")])

    return run


def repeats(documents: DataFrame, rid: str, *, shard_bytes: int = 4 << 20, often: int = 2000) -> DataFrame:
    """(rid, a, b) byte ranges under repeated windows; rid: a unique long of each row of documents (text)."""
    texts = documents.select(F.col(rid).alias("rid"), F.coalesce("text", F.lit("")).alias("text"))
    marks = materialize(texts.mapInArrow(_anchors, "rid long, h long, p int, most short, least short"), "dedup-anchors")
    number = marks.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h", (F.col("c") > often).alias("often"))
    twice = materialize(marks.join(number, "h"), "dedup-marks")
    discard(marks)
    shards = max(1, -(-twice.count() * 300 // shard_bytes))
    per_doc = twice.groupBy("rid").agg(F.collect_list(F.struct("h", "p", "most", "least", "often")).alias("marks"))
    docs = materialize(texts.join(per_doc, "rid"), "dedup-texts")
    discard(twice)
    met = docs.select("text", "marks").mapInArrow(_contexts(shards), _CONTEXT)
    hits = materialize(met.groupBy("shard").applyInArrow(_shard, _REPEATS), "dedup-repeats")
    at = docs.mapInArrow(_marks, "rid long, p int, ctx long")
    spans = at.join(hits.select("ctx", "lo", "hi"), "ctx")
    return spans.select("rid", (F.col("p") - F.col("hi")).alias("a"), (F.col("p") - F.col("lo") + WIDTH).alias("b"))


def remove_repeats(documents: DataFrame, *, keep_text: bool = False, carry: tuple[str, ...] = (), **params) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document (and kept: what remains as text, without bytes of characters cut through)."""
    narrow_batches(documents.sparkSession)
    # Row numbers are fixed by writing them once: (doc_id, text hash, copy) would tie for repeated rows.
    kept = [F.col(c) for c in carry]
    base = documents.select("doc_id", *carry, F.coalesce("text", F.lit("")).alias("text")).withColumn("rid", F.monotonically_increasing_id())
    base = materialize(base, "dedup-base")
    spans = repeats(base, "rid", **params)
    per_doc = materialize(spans.groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "dedup-spans")
    touched = base.select("rid", "text").join(per_doc, "rid").mapInArrow(_cut(keep_text), _CUT)
    touched = materialize(touched, "dedup-cut")
    joined = base.select("rid", "doc_id", *kept, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"), *["text"] * keep_text).join(touched, "rid", "left")
    out = joined.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"), *carry, *[F.coalesce("kept", "text").alias("kept")] * keep_text)
    return out
