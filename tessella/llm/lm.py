"""Language-model scores from a weighted backoff automaton.

Counts cover every token of every training document.  The model's states are the
histories with kept continuations; an arc (state, word) has a log-probability and
a next state, and a state without the arc follows its failure arc to the next
shorter history, adding that arc's weight.  The lowest state is the add-one
unigram model, whose value for a token is the ``base`` score's.

Estimates: absolute discounting, interpolated, so that for every history h
    p(w | h) = max(c(hw) - D, 0) / c(h) + bow(h) p(w | h')
    bow(h)   = (c(h) - sum over kept w of (c(hw) - D)) / c(h)
and the probabilities of a state sum to one whatever is pruned.  An n-gram is kept
if its count reaches ``min_count`` and all its words have a count of at least
``word_count``; both floors are the same at every size.  No word is dropped: the
others back off to the unigram state.

Its frequent part is one object: states and arcs of all words, bigrams and trigrams
whose counts reach three floors that rise with the order, so that every suffix and
prefix of a frequent n-gram is frequent.  At most ``hot_words`` words and ``hot_ngrams``
n-grams of either order are in it, with the probabilities and backoff weights of the
whole model.  It is broadcast, and every text is traversed by it once from left to
right: a token takes its arc, or fails to shorter histories until one has it.

Where a traversal fails on an n-gram that the rest of the model has, the true path
would have gone on there.  What that changes is one value for each such n-gram:
    word w         unigram(w) + bow(w)
    bigram ab      p(b | a) over what its backoff gives, + bow(ab)
    trigram abc    p(c | ab) over what its backoff gives
since a path's log-probability is the sum of these over its words, bigrams and
trigrams (telescoped).  The rest is kept as tables partitioned by n-gram, whose size is
not bounded by an executor; failed n-grams travel to them in packed blocks of a slice of
the keys, and sums by document travel back to the slab they came from.  A bitmap of fixed
size spares n-grams that are surely not kept the way.  How much of the model is broadcast
changes no result (see the tests).

Defined results: null text is the empty text and has the end token only; null
doc_id counts as the empty id for the folds; repeated rows count and score each;
with no training document every token has probability 1 / (0 + 1 * (0 + 1));
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Slab, as_long, crc_bucket, discard, materialize, mix, narrow_batches, slabs, word_hashes

END = U64(0xE4D0)  # the end token; word hashes are never this small in practice
PIECE = 96
STEP = U64(0x9E3779B97F4A7C15)


def tokens(slab: Slab) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end token after each text, and the number of tokens before each text."""
    h, before = word_hashes(slab)
    n = len(before) - 1
    out = np.insert(h, before[1:], END)
    return out, before + np.arange(n + 1)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * STEP + b)


def _counted(h: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if c is None:
        return np.unique(h, return_counts=True)
    u, inv = np.unique(h, return_inverse=True)
    return u, np.bincount(inv, c, len(u)).astype(np.int64)


def _sliced(batch: pa.RecordBatch, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Small batches: the JVM holds each one outside its heap."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, combined over the task as far as memory is bounded."""
    parts, held = [], 0
    names = ["w", "c"]

    def flush() -> pa.RecordBatch:
        u, c = _counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        return pa.RecordBatch.from_arrays([pa.array(as_long(u)), pa.array(c)], names)

    for batch in batches:
        for slab in slabs(batch.column(0), 1 << 20):
            parts.append(_counted(tokens(slab)[0]))
            held += len(parts[-1][0])
            if held > 1_000_000:
                yield from _sliced(flush())
                parts, held = [], 0
    if parts:
        yield from _sliced(flush())


@dataclass
class Table:
    """An open-addressed table of 64-bit keys."""

    keys: np.ndarray
    slot: np.ndarray

    @staticmethod
    def of(keys: np.ndarray) -> Table:
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        slot = np.full(size, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), (keys & U64(size - 1)).astype(np.int64)
        while len(left):
            free = slot[at] < 0
            slot[at[free]] = left[free]  # of several for one place the last wins; the others go on
            lost = slot[at] != left
            left, at = left[lost], (at[lost] + 1) & (size - 1)
        return Table(keys, slot)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys):
            return out
        mask = len(self.slot) - 1
        at = (keys & U64(mask)).astype(np.int64)
        got = self.slot[at]
        live = np.flatnonzero(got >= 0)
        while len(live):
            g = got[live]
            same = self.keys[g] == keys[live]
            out[live[same]] = g[same]
            live = live[~same]
            at[live] = (at[live] + 1) & mask
            got[live] = self.slot[at[live]]
            live = live[got[live] >= 0]
        return out


@dataclass
class Automaton:
    """State 0 is the root, then one a word, then one a bigram; arcs are keyed by state and word number.

    The first arcs are bigrams (from a word's state), the others trigrams.
    """

    words: Table
    base: np.ndarray  # log10 of the unigram model
    fail: np.ndarray  # state -> next shorter history
    weight: np.ndarray  # log10 of the failure arc
    arcs: Table
    arc_logp: np.ndarray
    arc_next: np.ndarray
    bigrams: int

    @staticmethod
    def arc_key(state: np.ndarray, word: np.ndarray) -> np.ndarray:
        return mix(state.astype(U64) << U64(32) | word.astype(U64))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Next states, log10 gains, and the length of the history whose arc was taken: 2, 1, or 0 at the root,
        where the unigram part is still to be added."""
        state = state.copy()
        gain = np.zeros(len(state))
        nxt = np.where(word >= 0, word + 1, 0).astype(np.int32)
        order = np.zeros(len(state), np.int8)
        todo = np.flatnonzero(state)
        while len(todo):
            known = word[todo] >= 0
            arc = np.full(len(todo), -1, np.int32)
            arc[known] = self.arcs.find(self.arc_key(state[todo[known]], word[todo[known]]))
            hit = arc >= 0
            taken, at = arc[hit], todo[hit]
            gain[at] += self.arc_logp[taken]
            nxt[at] = self.arc_next[taken]
            order[at] = 1 + (taken >= self.bigrams)
            todo = todo[~hit]
            gain[todo] += self.weight[state[todo]]
            state[todo] = self.fail[state[todo]]
            todo = todo[state[todo] > 0]
        return nxt, gain, order


def assemble(words: tuple[np.ndarray, ...], bigrams: tuple[np.ndarray, ...], trigrams: tuple[np.ndarray, ...]) -> Automaton:
    """From (hash, base, bow) of words, (hash, first, second, log p, bow) of bigrams and (hash of its bigram, second, third, log p) of trigrams.

    The words of a bigram and the bigrams of a trigram are given too.  An arc leads to
    the longest history that ends with its word.
    """
    word, base, word_bow = words
    two, x, y, p2, two_bow = bigrams
    xy, yz_first, z, p3 = trigrams
    number, place = Table.of(word), Table.of(two)
    n, m = len(word), len(two)
    first, second, third = number.find(x), number.find(y), number.find(z)
    head, tail = place.find(xy), place.find(pair_hash(yz_first, z))
    fail = np.concatenate([np.zeros(n + 1, np.int32), second + 1]).astype(np.int32)
    weight = np.concatenate([[0.0], word_bow, two_bow])
    keys = np.concatenate([Automaton.arc_key(first + 1, second), Automaton.arc_key(head + n + 1, third)])
    nxt = np.concatenate([np.arange(m) + n + 1, tail + n + 1]).astype(np.int32)
    return Automaton(number, base, fail, weight, Table.of(keys), np.concatenate([p2, p3]), nxt, m)


def traverse(auto: Automaton, word: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log10 gain of each token, and the length of the history whose arc it took.

    Each text is cut into pieces of PIECE tokens; a piece first reads the two
    tokens before it, which is all that a state remembers.
    """
    n = len(word)
    gain, order = np.zeros(n), np.zeros(n, np.int8)
    start, stop = before[:-1], before[1:]
    number = -(-(stop - start) // PIECE)
    text = np.repeat(np.arange(len(start)), number)
    k = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    lo = start[text] + k * PIECE
    hi = np.minimum(lo + PIECE, stop[text])
    state = np.zeros(len(lo), np.int32)
    for back in (2, 1):
        some = np.flatnonzero(lo - back >= start[text])
        state[some] = auto.step(state[some], word[lo[some] - back])[0]
    longest = np.argsort(lo - hi, kind="stable")
    lo, hi, state = lo[longest], hi[longest], state[longest]
    size = hi - lo
    for t in range(int(size.max()) if len(size) else 0):
        m = int(np.searchsorted(-size, -t, side="left"))  # pieces longer than t come first
        at = lo[:m] + t
        state[:m], gain[at], order[at] = auto.step(state[:m], word[at])
    return gain, order


def triple_hash(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return pair_hash(pair_hash(a, b), c)


BITS = 1 << 27  # of a bitmap; more keys than that make it useless, not wrong
CHUNK = 1 << 19


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap with the bit of every key g set."""

    def pack(group: pa.Table) -> pa.Table:
        on = np.zeros(CHUNK, np.uint8)
        on[group.column("p").to_numpy() & (CHUNK - 1)] = 1
        return pa.table({"k": pa.array(group.column("k").to_numpy()[:1]), "bits": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    at = keys.select(F.pmod("g", F.lit(BITS)).alias("p")).distinct().select(F.shiftright("p", 19).alias("k"), "p")
    out = np.zeros(BITS // 8, np.uint8)
    for row in at.groupBy("k").applyInArrow(pack, "k long, bits binary").toLocalIterator():
        out[row["k"] * (CHUNK // 8) : (row["k"] + 1) * (CHUNK // 8)] = np.frombuffer(row["bits"], np.uint8)
    return out


def _maybe(bits: np.ndarray, g: np.ndarray) -> np.ndarray:
    """False only for hashes that are no keys of the bitmap."""
    at = (g & U64(BITS - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _ngrams(shared, order: int):
    """Counts of n-grams inside texts (the end token may be last), combined over the task.

    Only n-grams whose words (bigrams) or bigrams (trigrams) may be kept are sent.
    """
    names = [*"xyz"[:order], "c"]

    def merged(cols: list[np.ndarray], c: np.ndarray | None) -> list[np.ndarray]:
        key = pair_hash(*cols) if order == 2 else triple_hash(*cols)
        _, first, inv = np.unique(key, return_index=True, return_inverse=True)
        return [*[x[first] for x in cols], np.bincount(inv, c, len(first)).astype(np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        parts, held = [], 0

        def flush() -> pa.RecordBatch:
            *cols, c = merged([np.concatenate([p[i] for p in parts]) for i in range(order)], np.concatenate([p[-1] for p in parts]))
            return pa.RecordBatch.from_arrays([*[pa.array(as_long(x)) for x in cols], pa.array(c)], names)

        for batch in batches:
            for slab in slabs(batch.column(0), 1 << 20):
                h, before = tokens(slab)
                doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
                ok = doc[:-1] == doc[1:]
                if order == 2:
                    one = _maybe(bits, h)
                    i = np.flatnonzero(ok & one[:-1] & one[1:])
                else:
                    # A trigram's count is at most its bigrams': only those of kept bigrams are looked at.
                    ok &= _maybe(bits, pair_hash(h[:-1], h[1:]))
                    i = np.flatnonzero(ok[:-1] & ok[1:])
                parts.append(merged([h[i + k] for k in range(order)], None))
                held += len(parts[-1][0])
                if held > 600_000:
                    yield from _sliced(flush())
                    parts, held = [], 0
        if parts:
            yield from _sliced(flush())

    return run


def _with_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the hashes of an n-gram (g) and, of a trigram, of its bigrams (xy, yz)."""
    for batch in batches:
        cols = {n: batch.column(n) for n in batch.schema.names}
        x, y, z = (cols[n].to_numpy().view(U64) if n in cols else None for n in "xyz")
        more = {"g": pair_hash(x, y)} if z is None else {"xy": pair_hash(x, y), "yz": pair_hash(y, z), "g": triple_hash(x, y, z)}
        cols |= {n: pa.array(as_long(v)) for n, v in more.items()}
        yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def _floor(counts: DataFrame, least: int, most: int) -> int:
    """A count that at most `most` rows reach: `least`, raised by doubling."""
    while counts.where(F.col("c") >= least).count() > most:
        least *= 2
    return least


@dataclass
class Model:
    """n, v and the value tables: words (g, c, base, v), bigrams (g, x, y, c, p, bow, v) and trigrams (xy, y, z, g, c, p, v).

    p: log10 of the probability; bow: log10 of the backoff weight; v: the value of an n-gram on a path.
    """

    n: int
    v: int
    words: DataFrame
    ngrams: list[DataFrame]


def train(documents: DataFrame, in_fold, *, word_count: int = 5, min_count: int = 3, discount: float = 0.75) -> Model:
    """The model from the rows where in_fold holds."""
    sc = documents.sparkSession.sparkContext
    texts = documents.where(in_fold).select("text")
    counts = materialize(texts.mapInArrow(_word_counts, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")), "lm-words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    known = counts.where(F.col("c") >= word_count)

    def counted(order: int, bits: np.ndarray) -> DataFrame:
        """n-grams that reach min_count, summed over all documents."""
        keys = "xyz"[:order]
        shared = sc.broadcast(bits)
        long = ", ".join(f"{k} long" for k in (*keys, "c"))
        found = texts.mapInArrow(_ngrams(shared, order), long).groupBy(*keys).agg(F.sum("c").alias("c")).where(F.col("c") >= min_count)
        out = materialize(found.mapInArrow(_with_hashes, f"{long}, {'' if order == 2 else 'xy long, yz long, '}g long"), f"lm-found-{order}")
        shared.destroy()
        return out

    unigram = lambda c: (F.col(c) + 1) / F.lit(float(n + v + 1))
    left = lambda whole: F.greatest(F.col(whole) - F.col("taken"), F.lit(1e-9)) / F.col(whole)
    taken = F.sum(F.col("c") - discount).alias("taken")
    # The bitmap lets some other words through: the joins drop their bigrams.
    found = counted(2, _bitmap(known.select(F.col("w").alias("g"))))
    pairs = found.join(known.select(F.col("w").alias("x"), F.col("c").alias("cx")), "x").join(known.select(F.col("w").alias("y"), F.col("c").alias("cy")), "y")
    pairs = materialize(pairs, "lm-pairs")
    discard(found)
    heads = pairs.groupBy("x").agg(taken, F.first("cx").alias("cx")).select("x", left("cx").alias("bow"))
    heads = materialize(heads, "lm-heads", small=True)
    p2 = (F.col("c") - discount) / F.col("cx") + F.col("bow") * unigram("cy")
    joined = pairs
    pairs = pairs.join(heads, "x").select("g", "x", "y", "c", p2.alias("p"), (F.log10(p2) - F.log10(F.col("bow") * unigram("cy"))).alias("v"))
    pairs = materialize(pairs, "lm-bigrams")
    discard(joined)
    words = counts.join(heads.withColumnRenamed("x", "w"), "w", "left").select(F.col("w").alias("g"), "c", F.log10(unigram("c")).alias("base"), (F.log10(unigram("c")) + F.coalesce(F.log10("bow"), F.lit(0.0))).alias("v"))
    words = materialize(words, "lm-values-1")
    discard(counts, heads)

    found = counted(3, _bitmap(pairs))
    triples = found.join(pairs.select(F.col("g").alias("xy"), F.col("c").alias("cxy")), "xy").join(pairs.select(F.col("g").alias("yz"), F.col("p").alias("low")), "yz")
    triples = materialize(triples.select("g", "xy", "y", "z", "c", "cxy", "low"), "lm-triples")
    discard(found)
    heads = materialize(triples.groupBy("xy").agg(taken, F.first("cxy").alias("cxy")).select("xy", left("cxy").alias("bow")), "lm-heads", small=True)
    p3 = (F.col("c") - discount) / F.col("cxy") + F.col("bow") * F.col("low")
    joined, bigrams, bow2 = triples, pairs, F.coalesce(F.log10("bow"), F.lit(0.0))
    triples = materialize(triples.join(heads, "xy").select("g", "xy", "y", "z", "c", F.log10(p3).alias("p"), (F.log10(p3) - F.log10(F.col("bow") * F.col("low"))).alias("v")), "lm-values-3")
    pairs = materialize(pairs.join(heads.withColumnRenamed("xy", "g"), "g", "left").select("g", "x", "y", "c", F.log10("p").alias("p"), bow2.alias("bow"), (F.col("v") + bow2).alias("v")), "lm-values-2")
    discard(joined, bigrams, heads)
    return Model(int(n), int(v), words, [pairs, triples])


@dataclass
class Hot:
    """The automaton of the frequent part, and a bitmap of all n-grams of each order."""

    auto: Automaton
    bits: list[np.ndarray]


def _hot(model: Model, hot_words: int, hot_ngrams: int) -> Hot:
    floor = 1
    parts = []
    for df, most, keys, values in ((model.words, hot_words, ["g"], ["base", "v"]), (model.ngrams[0], hot_ngrams, ["g", "x", "y"], ["p", "bow"]), (model.ngrams[1], hot_ngrams, ["xy", "y", "z"], ["p"])):
        # Floors rise with the order: what a frequent n-gram is made of is frequent too.
        floor = _floor(df, floor, most)
        rows = df.where(F.col("c") >= floor).select(*keys, *values).toArrow()
        parts.append([*(rows[k].to_numpy().astype(np.int64).view(U64) for k in keys), *(rows[v].to_numpy().astype(np.float64) for v in values)])
    word, base, v = parts[0]
    return Hot(assemble((word, base, v - base), tuple(parts[1]), tuple(parts[2])), [_bitmap(df) for df in model.ngrams])


SLICE_KEYS = 3_000_000  # n-grams looked up in one group
SLICE_VALUES = 500_000  # rows of the value tables in one group


def _score(shared, slices: int):
    """Each slab's scores by traversing its texts, and blocks of the words and n-grams that the traversal failed on.

    A slab is named by its task and place in it, both fixed by the scan. A block (slab, slice) keeps
    its keys document by document, 48 bits each; the slice holds the lowest bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, task, number = shared.value, TaskContext.get().partitionId(), 0
        for batch in batches:
            rid = batch.column(0)
            for slab in slabs(batch.column(1), 1 << 20):
                h, before = tokens(slab)
                n = slab.hi - slab.lo
                doc = np.repeat(np.arange(n), np.diff(before))
                w = hot.auto.words.find(h)
                in_hot = w >= 0
                own = hot.auto.base[w] if len(hot.auto.base) else np.zeros(len(w))
                base = np.bincount(doc[in_hot], own[in_hot], n)
                known = np.bincount(doc[in_hot], minlength=n)
                gain, order = traverse(hot.auto, w, before)
                rooted = in_hot & (order == 0)
                score = np.bincount(doc, gain, n) + np.bincount(doc[rooted], own[rooted], n)
                sent = [(doc[~in_hot], h[~in_hot])]
                same = doc[:-1] == doc[1:]
                two = pair_hash(h[:-1], h[1:])
                # Where no arc of that length was taken, the rest of the model may have one.
                i = np.flatnonzero(same & (order[1:] == 0))
                i = i[_maybe(hot.bits[0], two[i])]
                sent.append((doc[i], two[i]))
                i = np.flatnonzero(same[:-1] & same[1:] & (order[2:] < 2))
                g = pair_hash(two[i], h[i + 2])
                may = _maybe(hot.bits[1], g)
                sent.append((doc[i[may]], g[may]))
                name = (task << 32) + number
                number += 1
                rows = [(number % slices, 0, _bytes(np.diff(before).astype(np.int64), known.astype(np.int64), base, score), *[b""] * 5)]
                for kind, part in ((1, sent[:1]), (2, sent[1:])):
                    rows += _blocks(np.concatenate([d for d, _ in part]), np.concatenate([g for _, g in part]), kind, slices)
                head = pa.ListArray.from_arrays(pa.array([0, n, *[n] * (len(rows) - 1)], pa.int32()), rid.slice(slab.lo, n))
                cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int32(), *[pa.binary()] * 6))]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.int64()), head, *cols], _NAMES)

    return run


_NAMES = ["slab", "ids", "slice", "kind", "head", "docs", "size", "hi", "lo", "k"]  # kind 0: a slab's own row, 1: words, 2: n-grams


def _bytes(*columns: np.ndarray) -> bytes:
    return b"".join(c.tobytes() for c in columns)


def _blocks(doc: np.ndarray, g: np.ndarray, kind: int, slices: int) -> list[tuple]:
    """Blocks by slice of the distinct (document, key) pairs and how often each stands there."""
    part = (g & U64(slices - 1)).astype(np.int64)
    o = np.lexsort((g, doc, part))
    part, doc, g = part[o], doc[o], g[o]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])])) if len(g) else np.zeros(0, np.int64)
    k = np.diff(np.append(first, len(g)))
    part, doc, g = part[first], doc[first], g[first] >> U64(16)
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(g) else np.zeros(0, np.int64)
    out = []
    for i, j in zip(at, [*at[1:], len(g)], strict=False):
        docs, size = np.unique(doc[i:j], return_counts=True)
        wide = np.uint32 if max(docs[-1], size.max(), k[i:j].max()) >= 1 << 16 else np.uint16
        out.append((int(part[i]), kind, b"", *[x.astype(t).tobytes() for x, t in ((docs, wide), (size, wide), (g[i:j] >> U64(16), np.uint32), (g[i:j], np.uint16), (k[i:j], wide))]))
    return out


_PARTS = "slab long, ids {}, slice int, kind int, head binary, wide boolean, docs binary, known binary, base binary, part binary"


def _look_up(unseen: float):
    """Of a slice: sums of the values of each block's keys, document by document; slabs' own rows pass."""

    def run(sent: pa.Table, values: pa.Table) -> pa.Table:
        key = values["g"].to_numpy().view(U64) >> U64(16)
        o = np.argsort(key)
        key, base, v = key[o], values["base"].to_numpy()[o], values["v"].to_numpy()[o]
        kind = sent["kind"].to_numpy()
        out: list[list] = [[] for _ in range(5)]
        for m, docs, size, hi, lo, k in zip(kind.tolist(), *[sent[c].to_pylist() for c in ("docs", "size", "hi", "lo", "k")], strict=True):
            row = (False, b"", b"", b"", b"")
            if m:
                h = np.frombuffer(hi, np.uint32)
                wide = len(k) == 4 * len(h)
                docs, size, k = (np.frombuffer(x, np.uint32 if wide else np.uint16) for x in (docs, size, k))
                g = h.astype(U64) << U64(16) | np.frombuffer(lo, np.uint16)
                at = np.minimum(np.searchsorted(key, g), max(len(key) - 1, 0))
                hit = key[at] == g if len(key) else np.zeros(len(g), bool)
                start = np.cumsum(size, dtype=np.int64) - size
                # A word without a value was never seen; an n-gram without one is not kept.
                miss = unseen if m == 1 else 0.0
                total = lambda x: np.add.reduceat(np.where(hit, x[at] if len(x) else 0.0, miss) * k, start).tobytes()  # noqa: B023, E731
                row = (wide, docs.tobytes(), *((np.add.reduceat(hit * k.astype(np.int64), start).tobytes(), total(base)) if m == 1 else (b"", b"")), total(v))
            for c, x in zip(out, row, strict=True):
                c.append(x)
        cols = [pa.array(out[0], pa.bool_()), *[pa.array(c, pa.binary()) for c in out[1:]]]
        return pa.Table.from_arrays([*[sent[c] for c in ("slab", "ids", "slice", "kind", "head")], *cols], ["slab", "ids", "slice", "kind", "head", "wide", "docs", "known", "base", "part"])

    return run


def _total(group: pa.Table) -> pa.Table:
    """The documents of a slab: its own row and the sums of its blocks, in the order of slices."""
    group = group.sort_by([("kind", "ascending"), ("slice", "ascending")])
    ids = group["ids"].combine_chunks()
    ids = ids.slice(0, 1).flatten()
    head = np.frombuffer(group["head"][0].as_py(), np.int64).reshape(4, len(ids))
    count, known = head[0], head[1].copy()
    base, score = (head[i].view(np.float64).copy() for i in (2, 3))
    for m, wide, docs, n, b, v in zip(*[group[c].to_pylist() for c in ("kind", "wide", "docs", "known", "base", "part")], strict=True):
        if m:
            d = np.frombuffer(docs, np.uint32 if wide else np.uint16)
            score[d] += np.frombuffer(v)
            if m == 1:
                known[d] += np.frombuffer(n, np.int64)
                base[d] += np.frombuffer(b)
    return pa.table({"doc_id": ids, "n_tokens": count, "n_known": known, "base_score": base, "score": score})


def lm_scores(documents: DataFrame, *, holdout: tuple[int, int] = (7, 2), hot_words: int = 100_000, hot_ngrams: int = 400_000, slice_keys: int = SLICE_KEYS, **params) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    narrow_batches(documents.sparkSession)
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    held = crc_bucket(F.col("doc_id"), holdout[0]) == holdout[1]
    model = train(docs, ~held, **params)
    shared = documents.sparkSession.sparkContext.broadcast(_hot(model, hot_words, hot_ngrams))
    values = model.words.select("g", "base", "v")
    for df in model.ngrams:
        values = values.unionByName(df.select("g", F.lit(0.0).alias("base"), "v"))
    slices = 1
    while slices < max(values.count() / SLICE_VALUES, model.n / slice_keys):
        slices *= 2
    kind = docs.schema["doc_id"].dataType
    ids = f"array<{kind.simpleString()}>"
    sent = docs.mapInArrow(_score(shared, slices), f"slab long, ids {ids}, slice int, kind int, head binary, docs binary, size binary, hi binary, lo binary, k binary")
    sliced = values.withColumn("slice", F.pmod("g", F.lit(slices)).cast("int"))
    parts = sent.groupBy("slice").cogroup(sliced.groupBy("slice")).applyInArrow(_look_up(-math.log10(model.n + model.v + 1)), _PARTS.format(ids))
    scored = parts.groupBy("slab").applyInArrow(_total, f"doc_id {kind.simpleString()}, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", (crc_bucket(F.col("doc_id"), holdout[0]) == holdout[1]).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
