"""The pipeline: each stage against a plain version of its rule."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.conftest import DATA  # noqa: E402
from tests.llm.test_operators import slow_components, slow_repeats  # noqa: E402

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for name, f in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(f(spark, docs, SF), f"test-{name}")
        out.append(docs.toPandas())
    return out


def test_columns(steps):
    for s in steps[1:-1]:
        assert list(s.columns) == list(corpus_pipeline.COLUMNS)


def test_filter_keeps_most(steps):
    assert 0.7 * len(steps[0]) < len(steps[1]) <= len(steps[0])


def test_one_of_each(steps):
    rows = list(zip(steps[1].doc_id, steps[1].text, strict=True))
    assert set(steps[2].doc_id) == {c for _, _, c in slow_components(rows)}


def test_cut(steps):
    rows = [(i, t.encode()) for i, t in zip(steps[2].doc_id, steps[2].text, strict=True)]
    want = Counter((d, n - gone) for d, n, gone, _, _ in slow_repeats(rows))
    got = {i: len(t.encode()) for i, t in zip(steps[3].doc_id, steps[3].text, strict=True)}
    assert all(0 <= n - got[d] < 8 for d, n in want)  # characters cut through go as well
    assert (steps[3].n_chars == steps[3].text.str.len()).all()


def test_clean(spark, steps):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    wins = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = find(r["text"])
        k = min(10, len(w))
        wins |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    sizes = {len(x) for x in wins}
    dirty = {i for i, t in zip(steps[3].doc_id, steps[3].text, strict=True) if any(tuple((w := find(t))[j : j + k]) in wins for k in sizes for j in range(len(find(t)) - k + 1))}
    assert set(steps[4].doc_id) == set(steps[3].doc_id) - dirty


def test_ids(spark, steps):
    assert steps[5].round_trip.all() and set(steps[5].doc_id) == set(steps[4].doc_id)
    whole = corpus_pipeline.run(spark, SF).agg(F.count("*"), F.sum("ids_crc32")).first()
    assert tuple(whole) == (len(steps[5]), steps[5].ids_crc32.sum())
    assert zlib.crc32(b"") == 0


def test_toxicity_stage_keeps_all_without_evidence(spark, tmp_path):
    """Twelve rows, two labels, one of them toxic: the model knows no word, so its prior says nothing about a text."""
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 6) for i in range(10)] + [(None, None, None, None, None), (3, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars int")
    spark.createDataFrame([(1, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == 12


ODD = "doc_id long, text string, lang string, source string, n_chars int, _score double, _id string, kept string, h long, w string"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_takes_odd_rows(spark, name):
    """Null ids and texts, repeated rows, a long text, clashing names; then no rows at all."""
    stage = dict(corpus_pipeline.STAGES)[name]
    near = " ".join(f"w{i}" for i in range(60))
    texts = [(1, "a b c"), (2, None), (3, ""), (None, "null id"), (None, None), (4, "z" * 30_000), (5, near), (6, near + " tail"), (7, near), (7, near), (8, " \n\t ")]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "x", "y", 1, "z") for i, t in texts], ODD).repartition(3)
    out = stage(spark, rows, SF).toPandas()
    kept = Counter("null" if i != i or i is None else int(i) for i in out.doc_id)
    # Copies and near copies of 5 go in near_duplicates, where one row of an id stays; nothing else is lost.
    want = {1: 1, 2: 1, 3: 1, "null": 2, 4: 1, 5: 1, 6: 1, 7: 2, 8: 1}
    want |= {6: 0, 7: 0} if name == "near_duplicates" else {}
    assert kept == {k: n for k, n in want.items() if n}
    if name != "sentencepiece":
        assert list(out.columns) == list(corpus_pipeline.COLUMNS)
    assert stage(spark, rows.limit(0), SF).count() == 0
