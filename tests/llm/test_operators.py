"""The ten operators against brute force, round trips and edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import ann, binary_tokens, decontaminate, jaccard, lm, pieces, preference, sharding, suffix_dedup, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, _id string, rid int, h string, w string, score double, sh int"  # with names that clash inside


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z", 0.0, 3) for i, t in rows], DOCS).repartition(3)


def prose(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, empty, null, long, odd and repeated rows."""
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(1, 200)) for _ in range(60)]
    passage = prose(rng, 60)
    rows = list(enumerate(base))
    for k in range(40):
        words = base[k % 7 + 3].split()
        for _ in range(rng.randrange(0, 3)):
            if words:
                words[rng.randrange(len(words))] = f"e{rng.randrange(9)}"
        rows.append((100 + k, " ".join(words)))
    rows += [(200 + k, f"{prose(rng, 30)} {passage} {prose(rng, 20)}") for k in range(8)]
    rows += [(300, None), (301, ""), (302, "   \n\t"), (303, "a"), (304, "A b"), (305, "x" * 3000), (306, "ab" * 700), (307, prose(rng, 6000)), (308, "Ünï 中文 𝄞 ▁ <|endoftext|> \x85 it's  ,\n\n x"), (309, base[5]), (309, base[5])]
    return rows


@pytest.fixture(scope="module")
def df(spark, corpus):
    return docs(spark, corpus)


def none(spark):
    return spark.createDataFrame([], DOCS)


# Toxicity


def test_toxicity_learns_and_is_bounded(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        text = prose(rng, 60) + (" vile nasty" if bad else "") + prose(rng, 5)
        rows.append((i, text))
        if i % 5 < 3:
            labels.append((i, 1, int(bad)))
    rows += [(1000, None), (1001, ""), (None, "vile"), (1, "x"), (1, "x")]
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs(spark, rows), lab).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out & (got.doc_id < 900)]
    assert ((held.predicted == 1) == (held.doc_id % 6 == 0)).mean() > 0.98
    assert (got[got.doc_id < 900].held_out == [zlib.crc32(str(int(i)).encode()) % 4 == 2 for i in got[got.doc_id < 900].doc_id]).all()


def slow_risk(w, b, pos, unl, keys, prior):
    """The non-negative PU risk of a logistic model, document by document: value, corrected negative part, and its gradient."""
    def score(row):
        return b + sum(w[j] for j, k in enumerate(keys) if k in row)

    def sigma(x):
        return 1 / (1 + math.exp(-x))

    grad_pos, grad_neg = [0.0] * (len(keys) + 1), [0.0] * (len(keys) + 1)
    risk_pos = sum(-math.log(sigma(score(r))) for r in pos) / len(pos)
    negative = sum(-math.log(1 - sigma(score(r))) for r in unl) / len(unl) - prior * sum(-math.log(1 - sigma(score(r))) for r in pos) / len(pos)
    for rows, weight, out, label in ((pos, prior / len(pos), grad_pos, 1), (unl, 1 / len(unl), grad_neg, 0), (pos, -prior / len(pos), grad_neg, 0)):
        for r in rows:
            for j, k in enumerate([*keys, None]):
                if k is None or k in r:
                    out[j] += weight * (sigma(score(r)) - label)
    return prior * risk_pos + max(0.0, negative), negative, grad_pos, grad_neg


def test_toxicity_fit_by_a_slow_risk():
    """fit_nnpu against the same descent over risks and gradients that are worked out document by document; gradients against differences."""
    rng = random.Random(6)
    keys = [11, 22, 33, 44]
    pos = [{k for k in keys if rng.random() < 0.7} | {1} for _ in range(12)]
    unl = [{k for k in keys if rng.random() < 0.15} | {2} for _ in range(60)]
    as_rows = lambda rows: [np.array(sorted(r), np.uint64) for r in rows]
    prior = 0.2
    w, b = [0.3, -0.2, 0.1, 0.5], -0.7
    value, negative, gp, gn = slow_risk(w, b, pos, unl, keys, prior)
    assert negative > 0
    for j in range(5):
        up, down = list(w) + [b], list(w) + [b]
        up[j] += 1e-6
        down[j] -= 1e-6
        diff = (slow_risk(up[:4], up[4], pos, unl, keys, prior)[0] - slow_risk(down[:4], down[4], pos, unl, keys, prior)[0]) / 2e-6
        assert gp[j] + gn[j] == pytest.approx(diff, abs=1e-6)
    for epochs in (1, 5, 60):
        got = toxicity.fit_nnpu(as_rows(pos), as_rows(unl), prior, min_positive=2, epochs=epochs)
        chosen = got.keys.tolist()
        assert chosen and set(chosen) <= {*keys, 1}
        w, b, m, v = [0.0] * len(chosen), math.log(prior / (1 - prior)), [0.0] * (len(chosen) + 1), [0.0] * (len(chosen) + 1)
        for t in range(1, epochs + 1):
            _, negative, gp, gn = slow_risk(w, b, pos, unl, chosen, prior)
            g = [x + y for x, y in zip(gp, gn)] if negative >= 0 else [-y for y in gn]
            g = [x + 1e-3 * prior * (w[j] if j < len(w) else 0) for j, x in enumerate(g)]
            m = [0.9 * x + 0.1 * y for x, y in zip(m, g)]
            v = [0.999 * x + 0.001 * y * y for x, y in zip(v, g)]
            step = [0.1 * (x / (1 - 0.9**t)) / (math.sqrt(y / (1 - 0.999**t)) + 1e-8) for x, y in zip(m, v)]
            w, b = [max(x - s, 0) for x, s in zip(w, step)], b - step[-1]
        assert np.allclose(got.weights, w, atol=1e-6) and got.bias == pytest.approx(b, abs=1e-6)


def test_toxicity_without_positives_or_rows(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(none(spark), lab).count() == 0
    assert toxicity.toxicity(docs(spark, [(1, "a"), (2, None)]), lab).agg(F.sum("predicted")).first()[0] == 0


# SentencePiece


def slow_viterbi(v, word):
    table = {p: (v.scores[i], i) for i, p in enumerate(v.pieces) if p and not math.isnan(v.scores[i])}
    best = [(-math.inf, None)] * (len(word) + 1)
    best[0] = (0.0, [])
    for a in range(len(word)):
        s, ids = best[a]
        if ids is None:
            continue
        size = 1 if word[a] < 0x80 else 2 if word[a] < 0xE0 else 3 if word[a] < 0xF0 else 4
        for b in range(a + 1, min(len(word), a + 48) + 1):
            if word[a:b] in table:
                w, i = table[word[a:b]]
                if s + w > best[b][0]:
                    best[b] = (s + w, [*ids, i])
        if word[a : a + size] not in table and s + v.unknown > best[a + size][0]:
            best[a + size] = (s + v.unknown, [*ids, *[int(v.byte_ids[c]) for c in word[a : a + size]]])
    return best[-1][1]


@pytest.mark.parametrize("text", ["hello world", "  lead", "Étion dans, çouelle", "中文 ok", "a\nb 𝄞x", "", "▁ x", "supercalifragilistic 12345", "the the theory"])
def test_viterbi_is_the_best(text):
    v = pieces.vocabulary(PIECES)
    raw = text.encode()
    ids, count = pieces.encode(v, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    raw = raw.replace(pieces.META, b" ")
    want = [i for w in re.findall(rb" *[^ ]+| +", b" " + raw) for i in slow_viterbi(v, w)] if raw else []
    assert ids.tolist() == want and count.tolist() == [len(want)]
    assert pieces.decode(v, ids, count) == [raw]


def test_pieces_agree_with_the_library_where_floats_do():
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(open(PIECES, "rb").read())
    m.trainer_spec.model_type = 1
    lib, v = SentencePieceProcessor(model_proto=m.SerializeToString()), pieces.vocabulary(PIECES)
    for word in ["hello", "xthe", "reader", "ouelle", "schule", "agua", "stationary"]:
        ids = pieces.encode(v, np.frombuffer(word.encode(), np.uint8), np.array([0, len(word)]))[0].tolist()
        assert ids == lib.nbest_encode_as_ids(word, 2)[0]


def test_pieces_round_trip(spark, df, corpus):
    got = pieces.encode_decode(df, PIECES, keep_text=True).toPandas()
    assert len(got) == len(corpus) and got.round_trip.all()
    texts = Counter((i, (t or "").replace("▁", " ")) for i, t in corpus)
    assert Counter(zip(got.doc_id, got.decoded, strict=True)) == texts
    assert pieces.encode_decode(none(spark), PIECES).count() == 0


# Nearest neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 24)).astype(np.float32)
    x[100:300] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [1.0, None] + [0.0] * 22), (904, [1.0, 2.0]), (None, x[0].tolist()), (7, x[7].tolist())]
    emb = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = ann.neighbours(emb, F.col("vec_id") % 50 == 0).toPandas()
    y, hit = x.astype(np.float64), 0
    for q in range(0, 600, 50):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(600), d))[:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11))
        assert np.array_equal(mine.score.to_numpy(), d[mine.vec_id.to_numpy()])
        hit += len(set(want) & set(mine.vec_id))
    assert hit >= 0.9 * 120
    hot = got[got.query_id == 200].sort_values("rank").vec_id.tolist()
    assert hot == list(range(100, 110))


def test_few_and_no_candidates(spark):
    emb = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.5]), (2, [0.0, -3.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in ann.neighbours(emb, F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2]
    assert ann.neighbours(emb.limit(0), F.lit(True)).count() == 0


# Sharding


def test_shards(spark, df, corpus):
    big = df.unionByName(docs(spark, [(1000 + i, "same") for i in range(150)]))
    got = sharding.shard_documents(big, shards=16).toPandas()
    assert len(got) == len(corpus) + 150
    n = got.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert len(n) == 16 and n["count"].max() - n["count"].min() <= 1
    assert (n["min"] == 0).all() and (n["max"] == n["count"] - 1).all() and (n["nunique"] == n["count"]).all()
    sizes = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in corpus}
    assert all(sizes[r.doc_id] == (r.size, r.text_crc32) for r in got.itertuples() if r.doc_id in sizes)
    pairs = got[got.doc_id.isin([5, 309])]
    assert pairs.shard.nunique() == 1
    assert sharding.shard_documents(none(spark)).count() == 0


def test_groups_larger_than_a_shard_take_few_shards(spark):
    """1,000 of 3,000 rows have one text, 16 shards: six hold them, seven are allowed."""
    rows = [(i, "same text" if i < 1000 else f"pair {i // 2}" if i < 1600 else f"alone {i}") for i in range(3000)]
    got = sharding.shard_documents(docs(spark, rows), shards=16).toPandas()
    assert got.groupby("shard").size().max() - got.groupby("shard").size().min() <= 1
    assert got[got.doc_id < 1000].shard.nunique() <= 7
    pairs = got[(got.doc_id >= 1000) & (got.doc_id < 1600)]
    assert (pairs.groupby(pairs.doc_id // 2).shard.nunique() == 1).mean() > 0.95


def test_cut_links_by_brute_force_and_rounds_cut_less(spark):
    rng = random.Random(4)
    rows = [(g, s, rng.randrange(4), 1) for g in range(60) for s in range(rng.choice([2, 3, 9]))] + [(99, s, rng.randrange(4), 1) for s in range(70)]
    state = sharding.materialize(spark.createDataFrame(rows, "grp long, sub int, shard int, n long"), "test-state")

    def cut(rs):
        by = {}
        for g, _, shard, n in rs:
            by.setdefault(g, Counter())[shard] += n
        return sum(sum(c.values()) - 1 for c in by.values()), sum(sum(c.values()) - max(c.values()) for c in by.values())

    assert tuple(sharding.cut_links(state).first()) == cut(rows)
    quota = -(-len(rows) // 4) + 8
    after = [tuple(r) for r in sharding.propagate(state, 4, quota).select("grp", "sub", "shard", "n").collect()]
    assert max(Counter(r[2] for r in after).values()) <= max(quota, *Counter(r[2] for r in rows).values())
    assert cut(after)[1] < cut(rows)[1] / 3 and len(after) == len(rows)


def test_shards_of_ties_and_null_ids(spark):
    rows = [(None, "a"), (None, "a"), (None, None), (1, None), (1, "b"), (1, "b"), (2, "")]
    got = sharding.shard_documents(docs(spark, rows), shards=2).toPandas()
    assert sorted(got.slot[got.shard == 0]) == list(range((got.shard == 0).sum())) and len(got) == 7
    assert abs((got.shard == 0).sum() - (got.shard == 1).sum()) == 1


# Suffix arrays


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(1500):
        x = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 40))]
        assert suffix_dedup.suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def slow_repeats(rows):
    seen = Counter(t[i : i + 200] for _, t in rows for i in range(len(t) - 199))
    for doc, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        yield doc, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()


@pytest.mark.parametrize("often", [2000, 1])
def test_repeats(df, corpus, often):
    got = suffix_dedup.remove_repeats(df, often=often).toPandas()
    want = Counter(slow_repeats([(i, (t or "").encode()) for i, t in corpus]))
    assert Counter(got[["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False, name=None)) == want


def test_repeats_of_nothing(spark):
    assert suffix_dedup.remove_repeats(none(spark)).count() == 0


# Jaccard


def slow_components(rows):
    sets = []
    for doc, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append((doc, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()))
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 4 * len(a & b) >= 3 * len(a | b):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        low[root(i)] = min(low.get(root(i), d), d)
    return Counter((d, len(s), low[root(i)]) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize("hot", [24, 2])
def test_components(df, corpus, hot):
    got = jaccard.near_duplicates(df, hot=hot, slice_keys=500).toPandas()
    assert Counter(got[["doc_id", "n_shingles", "component_id"]].itertuples(index=False, name=None)) == slow_components(corpus)


def test_components_of_many_near_copies(spark):
    rng = random.Random(9)
    base = prose(rng, 80).split()
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"q{rng.randrange(50)}"
        rows.append((k, " ".join(w)))
    rows += [(500 + k, " ".join(base[:40]) + " " + prose(rng, 40)) for k in range(80)]
    got = jaccard.near_duplicates(docs(spark, rows), hot=4).toPandas()
    assert Counter(got[["doc_id", "n_shingles", "component_id"]].itertuples(index=False, name=None)) == slow_components(rows)


def test_blocks_of_large_lists_and_rounds(spark, df, corpus, monkeypatch):
    """Lists are dealt in small blocks and a component offers one pair a round: nothing is lost."""
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "LONG", 4)
    monkeypatch.setattr(jaccard, "ROUNDS", (1, None))
    got = jaccard.near_duplicates(df, hot=2).toPandas()
    assert Counter(got[["doc_id", "n_shingles", "component_id"]].itertuples(index=False, name=None)) == slow_components(corpus)


def test_similar_pairs_and_null_ids(spark, corpus):
    rows = [*corpus[:110], (None, corpus[4][1]), (None, "only here with no id at all"), (None, None)]
    got = jaccard.similar_pairs(docs(spark, rows), hot=3).collect()
    sets = {}
    for d, t in rows:
        w = (t or "").lower().split()
        if w:
            k = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
            sets[k] = min(sets.get(k, 10**9), 10**9 if d is None else d)
    keys = sorted(sets, key=sets.get)
    want = {(sets[a], sets[b]) for i, a in enumerate(keys) for b in keys[i + 1 :] if 4 * len(a & b) >= 3 * len(a | b)}
    assert len(got) == len(want) and {(r.set_a, r.set_b) for r in got} == want
    near = jaccard.near_duplicates(docs(spark, rows)).where("doc_id is null").collect()
    assert sorted(str(r.component_id) for r in near) == ["4", "None", "None"]


def test_keep_first(spark, df, corpus):
    kept = jaccard.keep_first(df).toPandas()
    want = {c for _, n, c in slow_components(corpus) if n} | {300, 301, 302}
    assert set(kept.doc_id) == want and list(kept.columns) == df.columns
    assert jaccard.near_duplicates(none(spark)).count() == 0


# Preference pairs


def test_preference(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "yo"), (0, 2, "assistant", "more"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", None), (3, 0, "user", ""), (4, 0, None, "x"), (None, 0, "user", "z")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("_p", F.expr("conv_id div 2")).withColumn("body", F.lit(1))
    got = {r["pair_id"]: r for r in preference.preference_pairs(t, "_p", F.col("conv_id") % 2 == 0).collect()}
    a = got[0]
    assert (a["prompt_turns"], a["prompt"], a["status"]) == (1, "<|user|>\nhi<|end|>\n", "paired")
    assert [a["chosen"][s["start"] : s["end"]] for s in a["chosen_spans"]] == ["yo<|end|>\n", "more<|end|>\n"]
    assert [a["rejected"][s["start"] : s["end"]] for s in a["rejected_spans"]] == ["no<|end|>\n"]
    assert (got[1]["prompt_turns"], got[1]["chosen"], got[1]["rejected"]) == (1, "", "")
    assert (got[2]["status"], got[2]["rejected"], got[2]["chosen"]) == ("unpaired", None, "<|unknown|>\nx<|end|>\n")
    assert set(got) == {0, 1, 2}
    assert preference.preference_pairs(t.limit(0), "_p", F.lit(True)).count() == 0


# Decontamination


def test_decontamination(spark, corpus):
    rng = random.Random(4)
    items = [(1, prose(rng, 15)), (2, "Short item HERE"), (3, ""), (4, None), (None, "w1 w2"), (5, "w3 " * 12), (10, prose(rng, 10))]
    rows = [*corpus, (400, "zz " + items[0][1].upper() + " zz"), (401, "a short-item: here! b"), (402, "w3 " * 30), (403, items[6][1] + " " + items[0][1]), (None, "short item here")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("word", F.lit(1))
    got = decontaminate.contamination(docs(spark, rows), bench).toPandas()
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    wins = [(i, w[k : k + min(10, len(w))]) for i, t in items if i is not None and (w := find(t)) for k in range(len(w) - min(10, len(w)) + 1)]
    want = Counter()
    for d, t in rows:
        w, hit, its = find(t), set(), set()
        for i, x in wins:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit |= set(range(k, k + len(x)))
                    its.add(str(i))
        want[d, len(w), len(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest(), bool(hit)] += 1
    assert Counter((None if r[0] != r[0] else r[0], *r[1:]) for r in got.itertuples(index=False, name=None)) == want
    clean = decontaminate.clean(docs(spark, rows), bench)
    assert clean.count() == sum(v for k, v in want.items() if not k[-1])
    assert decontaminate.contamination(none(spark), bench).count() == 0
    assert decontaminate.contamination(docs(spark, rows), bench.limit(0)).where("contaminated").count() == 0


# Token files


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 300, 5000)
    m, ids, n = binary_tokens.load(binary_tokens.dump(x, [1, None], [4000, 1000], 300))
    assert np.array_equal(m.decode(), x) and ids == [1, None] and n == [4000, 1000]
    for i in (0, 17, 4999):
        assert m.access(i) == x[i]
    for v in (0, 5, 299):
        at = np.flatnonzero(x == v)
        assert m.count(v) == len(at) and m.rank(v, 2500) == (at < 2500).sum()
        assert [m.select(v, k) for k in range(len(at))] == at.tolist()
    with pytest.raises(IndexError):
        m.select(0, 10**6)


def test_token_files(spark, df, corpus):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    got = binary_tokens.token_files(df, BPE, shard_bytes=4000).toPandas()
    want, start = Counter(), 0
    for d, t in sorted(corpus, key=lambda r: r[0]):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want[d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        start += len(ids)
    assert Counter(got[["doc_id", "start", "n_tokens", "ids_crc32"]].itertuples(index=False, name=None)) == want
    assert binary_tokens.token_files(none(spark), BPE).count() == 0


# Language model


def test_lm(spark, df, corpus):
    got = lm.lm_scores(df, word_count=2, min_count=2).toPandas()
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    c = Counter()
    for d, t in corpus:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            c.update([*split(t), None])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(corpus) and (got.train_tokens == n).all() and (got.score < 0).all()
    by = {d: t for d, t in corpus}
    for r in got.itertuples():
        w = [*split(by[r.doc_id]), None]
        assert (r.n_tokens, r.n_known) == (len(w), sum(c[x] > 0 for x in w))
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
    train = got[~got.held_out]
    assert train.score.sum() > train.base_score.sum()


def test_automaton_states_sum_to_one_and_pieces_do_not_matter(spark, df, monkeypatch):
    rng = np.random.default_rng(0)
    model = lm.train(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), F.lit(True), word_count=2, min_count=2)
    auto = lm._hot(model, 10**6, 10**6).auto
    words, states = len(auto.base), len(auto.fail)
    assert words == model.v and states > words + 100 and len(auto.arc_logp) > auto.bigrams > 0
    uni = 10.0**auto.base
    for s in [0, *rng.integers(1, words + 1, 40), *rng.integers(words + 1, states, 80)]:
        _, gain, order = auto.step(np.full(words, s, np.int32), np.arange(words))
        p = 10.0**gain * np.where(order == 0, uni, 1)
        left = 10.0 ** auto.step(np.array([s], np.int32), np.array([-1]))[1][0] * (1 - uni.sum())
        assert p.sum() + left == pytest.approx(1)
    w = rng.integers(-1, words, 1000)
    whole = lm.traverse(auto, w, np.array([0, 400, 400, 1000]))
    monkeypatch.setattr(lm, "PIECE", 10**6)
    again = lm.traverse(auto, w, np.array([0, 400, 400, 1000]))
    assert np.allclose(whole[0], again[0]) and np.array_equal(whole[1], again[1])


def test_frequent_part_of_the_automaton_is_closed(spark, df):
    """Whatever is broadcast, arcs lead to states that are there, and every suffix of a frequent n-gram is frequent."""
    model = lm.train(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), F.lit(True), word_count=2, min_count=2)
    for most in ((10**6, 10**6), (60, 40), (10, 1000), (1000, 3), (0, 50)):
        auto = lm._hot(model, *most).auto
        n, m = len(auto.base), auto.bigrams
        assert n <= most[0] and m <= most[1] and len(auto.arc_logp) - m <= most[1] and len(auto.fail) == 1 + n + m
        assert (auto.arc_next > n).all() and (auto.arc_next < 1 + n + m).all() and (auto.fail[1 + n :] > 0).all() and (auto.fail[1 + n :] <= n).all()


def test_lm_of_nothing(spark):
    assert lm.lm_scores(none(spark)).count() == 0
    assert lm.lm_scores(docs(spark, [(1, None), (2, "a b")])).count() == 2


def test_lm_model_is_whole_whatever_is_broadcast(spark, df, corpus):
    """Scores by a plain model with every n-gram, and no change when the broadcast part holds little or nothing."""
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")), None]
    one, two, three = Counter(), Counter(), Counter()
    for d, t in corpus:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            w = split(t)
            one.update(w)
            two.update(zip(w, w[1:]))
            three.update(zip(w, w[1:], w[2:]))
    n, v, disc = sum(one.values()), len(one), 0.75
    two = {k: c for k, c in two.items() if c >= 2 and min(one[k[0]], one[k[1]]) >= 2}
    three = {k: c for k, c in three.items() if c >= 2 and k[:2] in two and k[1:] in two}
    took = Counter()
    for k, c in [*two.items(), *three.items()]:
        took[k[:-1]] += c - disc
    bow1 = {a: max(one[a] - took[a,], 1e-9) / one[a] for a, _ in two}
    bow2 = {k[:2]: max(two[k[:2]] - took[k[:2]], 1e-9) / two[k[:2]] for k in three}

    def p(x, y, z):
        u = (one[z] + 1) / (n + v + 1)
        low = (max(two.get((y, z), 0) - disc, 0) / one[y] if (y, z) in two else 0) + bow1.get(y, 1) * u
        return ((three[x, y, z] - disc) / two[x, y] if (x, y, z) in three else 0) + bow2.get((x, y), 1) * low

    by = dict(corpus)
    for hot in ({}, {"hot_words": 20, "hot_ngrams": 10}, {"hot_words": 200, "hot_ngrams": 30}, {"hot_words": 0, "hot_ngrams": 0}):
        for r in lm.lm_scores(df, word_count=2, min_count=2, **hot).collect():
            w = [0, 0, *split(by[r["doc_id"]])]
            assert r["score"] == pytest.approx(sum(math.log10(p(*w[i - 2 : i + 1])) for i in range(2, len(w))))
            assert r["n_known"] == sum(one[x] > 0 for x in w[2:])


def test_long_words_take_linear_time_and_vocabularies_are_checked():
    import time

    v = pieces.vocabulary(PIECES)
    rng = random.Random(3)
    took = []
    for n in (10_000, 40_000):
        raw = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n)).encode()
        began = time.process_time()
        ids, count = pieces.encode(v, np.frombuffer(raw, np.uint8), np.array([0, n]))
        took.append(time.process_time() - began)
        assert pieces.decode(v, ids, count)[0] == raw
    assert took[1] < 8 * max(took[0], 0.2)
    assert not any(b" " in p.lstrip(b" ") for p in v.pieces if len(p) > 1)


def test_neighbours_of_repeated_ids(spark):
    """Only the query's own row is left out: other vectors of its id are candidates."""
    rng = np.random.default_rng(2)
    rows = [(0, [1.0, 0.0, 0.0, 0.0])] + [(0, [1.0, 0.01 * i, 0.0, 0.0]) for i in range(1, 15)] + [(i, rng.normal(size=4).tolist()) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.neighbours(df, F.col("vec_id") % 100 == 0).where("vec_id = 0").groupBy("query_id", "rank", "vec_id", "score").count().collect()
    near = [r for r in got if r["vec_id"] == 0]
    assert len({r["rank"] for r in near}) == 10 and all(r["score"] < 0.15 for r in near)


def test_training_sample_is_the_same_in_every_run(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 20) + (" vile slur" if i % 3 == 0 else "")) for i in range(400)] + [(0, "again " + prose(rng, 5))] * 5
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    a, b = (toxicity.train(docs(spark, rows).repartition(k), labels, max_positive=30, max_unlabelled=60) for k in (1, 5))
    assert np.array_equal(a.keys, b.keys) and np.allclose(a.weights, b.weights) and a.bias == pytest.approx(b.bias)


def test_recall_on_the_embeddings_table(spark):
    """Queries: ids divisible by 50, against all rows; the share of the true ten nearest that is found."""
    emb = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in emb.collect() if r["embedding"] and all(x is not None and math.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    found = ann.neighbours(emb, F.col("vec_id") % 50 == 0).toPandas().groupby("query_id")["vec_id"].agg(set)
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        near = [int(ids[k]) for k in np.lexsort((ids, d)) if k != q][:10]
        hit, total = hit + len(found[ids[q]] & set(near)), total + len(near)
    print("recall", hit / total)
    assert hit >= 0.9 * total
