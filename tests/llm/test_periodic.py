"""op13: periodic runs against brute force."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from tessella.llm import periodic

DOCS = "doc_id long, text string, _id string, runs string, n_words int, _best int, collapsed long"


def plain_runs(words):
    """Every run by its definition: each period, each maximal stretch, smallest period only."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            if len(stretch) >= max(12, 2 * q) and not any(all(a == b for a, b in zip(stretch, stretch[p:], strict=False)) for p in range(1, q)):
                out.append((i, len(stretch), q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *(best + (1000 * best[1] // best[2],) if best else (None,) * 4), sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def shapes():
    rng = random.Random(3)
    yield from ([rng.randrange(k) for _ in range(rng.randrange(0, 90))] for k in (1, 2, 2, 2, 3, 3, 5, 9) for _ in range(25))
    for _ in range(60):  # nested repeats of repeats
        w = [rng.randrange(3) for _ in range(rng.randrange(1, 7))]
        for _ in range(rng.randrange(1, 4)):
            w = w * rng.randrange(1, 5) + [rng.randrange(4) for _ in range(rng.randrange(0, 4))]
        yield w[:260]
    for _ in range(40):  # long periods, neighbours that nearly go on
        q = rng.randrange(16, 60)
        w = [rng.randrange(rng.choice((2, 30))) for _ in range(q)]
        yield [rng.randrange(30) for _ in range(rng.randrange(20))] + (w * 5)[: rng.randrange(2 * q - 2, 4 * q)] + w[:3] + (w * 3)[: rng.randrange(3 * q)]


def test_runs_equal_brute_force():
    for w in shapes():
        assert periodic.find_runs(np.array(w, np.int64)) == plain_runs(w), w


@pytest.mark.parametrize("cost", [0.0, 0.01, 0.1, 1e9])
def test_lag_counts_are_exact_whatever_is_heavy(cost, monkeypatch):
    monkeypatch.setattr(periodic, "PAIRS", 37)
    rng = np.random.default_rng(1)
    for n in (1, 2, 13, 400):
        ids = np.unique(rng.zipf(1.4, n).clip(1, 50), return_inverse=True)[1]
        assert periodic.lag_counts(ids, cost)[1:].tolist() == [int((ids[:-q] == ids[q:]).sum()) for q in range(1, n // 2 + 1)]


def test_long_texts_stay_near_linear():
    rng = np.random.default_rng(2)
    took = []
    for n in (30_000, 120_000):
        start = time.process_time()
        assert periodic.find_runs(np.zeros(n, np.int64)) == [(0, n, 1)]
        tail = np.concatenate([np.unique(rng.zipf(1.3, n).clip(1, 5000), return_inverse=True)[1], np.zeros(n, np.int64)])
        assert (n, 1) in {(length // 1000 * 1000, q) for _, length, q in periodic.find_runs(tail)}
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0] + 1


def test_query_equals_brute_force_over_odd_rows(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randrange(rng.choice((2, 5, 300)))}" for _ in range(rng.randrange(0, 150)))) for i in range(150)]
    rows += [(300, None), (301, ""), (302, " \n\t\x0b\x0c\r "), (303, "a"), (304, "é " * 40), (305, "x" * 3000), (306, "a\x85b c " * 13), (309, "a b " * 9), (309, "a b " * 9), (None, "a b c " * 8), (None, None)]
    df = spark.createDataFrame([(i, t, "x", "y", 1, 2, 3) for i, t in rows], DOCS).repartition(3)
    got = sorted((tuple(r) for r in periodic.run_digest(df).drop("n_words").collect()), key=str)
    assert got == sorted(((i, *plain_digest(i, t)) for i, t in rows), key=str)
    assert periodic.run_digest(df.limit(0)).count() == 0


def test_operator_gives_texts_and_spans(spark):
    out = periodic.periodic_runs(spark.createDataFrame([(1, "start " + "la di da " * 5 + "end")], "doc_id int, text string")).first()
    assert [tuple(r) for r in out["runs"]] == [(1, 15, 3)] and out["collapsed"] == "start la di da end" and out["n_words"] == 17
