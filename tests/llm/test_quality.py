"""op12: quality scores against plain linear algebra, plain isotonic fits and held-out labels."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import quality, queries
from tessella.llm.common import slabs

DOCS = "doc_id long, text string, stats int, y string, fold string, score int, i int, part int, v int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "x", 2, 3, 4, 5) for i, t in rows], DOCS).repartition(3)


def plain_stats(text):
    """Some of the statistics, written from their names."""
    b = text.encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", b)
    lines = [x for x in b.split(b"\n") if x]
    n = max(len(b), 1)
    return {
        "log_bytes": math.log1p(len(b)), "log_words": math.log1p(len(w)), "word_bytes": sum(map(len, w)) / max(len(w), 1), "long_word": math.log1p(max(map(len, w), default=0)),
        "upper": sum(65 <= c < 91 for c in b) / n, "calls": b.count(b"!") / n, "spaces": sum(c in b" \t\n\r\x0b\x0c" for c in b) / n, "foreign": sum(c > 127 for c in b) / n,
        "distinct_words": len(set(w)) / max(len(w), 1), "top_word": max((w.count(x) for x in set(w)), default=0) / max(len(w), 1), "same_word_next": sum(x == y for x, y in zip(w, w[1:])) / max(len(w), 1),
        "distinct_lines": len(set(lines)) / max(len(lines), 1), "entropy": -sum(b.count(c) / n * math.log2(b.count(c) / n) for c in set(b)), "ended_lines": sum(x[-1:] in b".!?" for x in lines) / max(len(lines), 1),
        "no_letter": sum(not re.search(rb"[A-Za-z\x80-\xff]", x) for x in w) / max(len(w), 1), "distinct_pairs": len(set(zip(w, w[1:]))) / max(len(w) - 1, 1),
    }


def test_statistics_by_their_names():
    texts = ["", " \n", "One two TWO two two!\nÉté 42 | é.\nOne", "a", "x" * 5000, "la la la\nla la la\n\nb?"]
    got = np.concatenate([quality.text_stats(s) for s in slabs(pa.array(texts), 60)])
    for t, row in zip(texts, got, strict=True):
        for name, v in plain_stats(t).items():
            assert row[quality.STATS.index(name)] == pytest.approx(v, abs=1e-4), (t, name)


def test_pooling_is_the_isotonic_fit():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = int(rng.integers(1, 25))
        y, w = rng.integers(0, 2, n).astype(float), rng.integers(1, 5, n).astype(float)
        x, v = quality.pool_adjacent(np.arange(n, dtype=float), y, w)
        mean = lambda i, j: np.average(y[i : j + 1], weights=w[i : j + 1])
        want = [max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
        assert np.all(np.diff(v) > 0) and sorted(set(np.round(want, 9))) == sorted(set(np.round(v, 9)))


def test_features_give_the_gaussian_kernel_and_sums_give_ridge(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, len(quality.STATS))).astype(np.float32)
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    rows = spark.createDataFrame([(r.tobytes(), int(i % quality.FOLDS), float(t)) for i, (r, t) in enumerate(zip(x, y))], "stats binary, fold int, y double").repartition(7)
    m = quality.fit(rows, features=4000, width=1.5)
    z = m.features(x.astype(float))[:, :-1]
    s = (x - x.mean(0)) / x.std(0)
    kernel = np.exp(-((s[:50, None] - s[None, :50]) ** 2).sum(2) / (2 * (1.5**2) * x.shape[1]))
    assert np.abs(z[:50] @ z[:50].T - kernel).max() < 0.1
    small = quality.fit(rows, features=40)
    z = small.features(x.astype(float))
    want = np.linalg.solve(z.T @ z + np.diag([1e-4 * 300] * 40 + [1e-9]), z.T @ y)
    assert np.allclose(small.weights, want, atol=1e-5)
    assert np.array_equal(quality.fit(rows, features=40).weights, small.weights)
    assert np.all(np.diff(small.knots[1]) > 0)


def test_held_out_labels_are_met(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op12_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("q")), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out]
    good, bad = held[held.q == 1].score.to_numpy(), held[held.q == 0].score.to_numpy()
    auc = ((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2).item()
    assert len(held) > 500 and auc > 0.99 and ((held.predicted == 1) == (held.q == 1)).mean() > 0.97
    assert abs(held.score.mean() - held.q.mean()) < 0.05


def test_odd_rows_and_no_labels(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(30)) if i % 2 else "| # " * 20) for i in range(80)]
    odd = [(None, "a b"), (200, None), (201, ""), (202, " \n\t"), (203, "é" * 40_000), (1, rows[1][1]), (1, rows[1][1])]
    lab = spark.createDataFrame([(i, i % 2, 0, "z") for i in range(60)] + [(None, 1, 1, "z"), (3, None, 1, "z"), (5, 1, 0, "z")], "doc_id long, quality int, toxic int, text string")
    got = quality.quality(frame(spark, rows + odd), lab).toPandas()
    assert len(got) == len(rows + odd) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out & (got.doc_id < 80)]
    assert ((held.predicted == 1) == (held.doc_id % 2 == 1)).all()
    assert got[got.doc_id == 1].score.nunique() == 1
    nothing = lab.limit(0)
    assert set(quality.quality(frame(spark, odd), nothing).toPandas().score) == {0.5}
    assert set(quality.quality(frame(spark, rows), lab.where("quality = 1")).toPandas().score.round(6)) == {1.0}
    assert quality.quality(frame(spark, rows).limit(0), lab).count() == 0
