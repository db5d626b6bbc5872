"""Positive-unlabelled scores: the risk and its fit against plain sums, the prior, and held-out accuracy."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stormglass.llm import pu

SMALL = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def given(spark):
    return tuple(spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))


def matrix(rows):
    x = np.stack([np.frombuffer(r.x, dtype=np.float32) for r in rows]).astype(float)
    return x, np.array([r.positive for r in rows]), np.array([r.half for r in rows])


def test_held_out_accuracy_and_contract(given):
    docs, labels = given
    out = pu.judge(docs, labels).toPandas()
    assert list(out.columns) == ["doc_id", "held_out", "score", "predicted"] and len(out) == docs.count()
    assert out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]).all()
    both = out[out.held_out].merge(labels.toPandas(), on="doc_id")
    for label, least in ((1, 0.97), (0, 0.85)):
        assert (both[both.quality == label].predicted == label).mean() >= least


def test_labels_of_held_out_rows_and_negatives_are_not_used(given):
    docs, labels = given
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    rows = [pu.prepared(docs, x).select("doc_id", "positive").orderBy("doc_id").collect()
            for x in (labels, other, labels.filter("quality = 1"))]
    assert rows[0] == rows[1] == rows[2]


def test_fit_equals_plain_newton_and_keeps_the_bound(given):
    docs, labels = given
    rows = pu.prepared(docs, labels).filter("NOT held_out")
    model = pu.learn(rows, prior=0.85)
    x, positive, _ = matrix(rows.collect())
    mean, dev = x.mean(axis=0), x.std(axis=0)
    assert np.allclose(model.scaling.mean, mean) and np.allclose(model.scaling.scale[dev > 1e-6], dev[dev > 1e-6])
    z = np.concatenate([np.clip((x - model.scaling.mean) / model.scaling.scale, -pu.CLIP, pu.CLIP), np.ones((len(x), 1))], axis=1)
    f = z @ model.weights
    plus = 0.85 * np.log1p(np.exp(-f[positive])).mean()
    r = np.log1p(np.exp(f)).mean() - 0.85 * np.log1p(np.exp(f[positive])).mean()
    assert r >= 0 and np.allclose(model.course[-1], (plus + r, r), atol=1e-9)
    assert [c[0] for c in model.course] == sorted((c[0] for c in model.course), reverse=True) and model.course[0][0] < np.log(2)


def test_prior_from_histograms():
    rng = np.random.default_rng(1)
    bins = np.linspace(-8, 8, 401)
    for prior in (0.2, 0.5, 0.9):
        n = 40_000
        positive = np.histogram(rng.normal(2, 1, n), bins)[0]
        hidden = np.concatenate([rng.normal(2, 1, int(n * prior)), rng.normal(-2, 1, n - int(n * prior))])
        assert abs(pu.best_bound(np.histogram(hidden, bins)[0], positive) - prior) < 0.03
    assert pu.best_bound(np.zeros(4), np.ones(4)) == 0.5


def test_counts_of_a_text_do_not_depend_on_the_cuts():
    words = ["Abc", "def,", "GHI", "a.b", "99", "éé", "\n", "x!!"]
    text = " ".join(words[i % 8] for i in range(4_000))
    (whole,) = [x for *_, x in pu.text_features(pa.array([text]))]
    (cut,) = [x for *_, x in pu.text_features(pa.array([text]), limit=1_000)]
    exact = [0, 1, *range(2, 2 + pu.N_KINDS)]  # sizes and byte groups; word figures may differ at a cut
    assert np.allclose(whole[0][exact], cut[0][exact]) and np.allclose(whole, cut, atol=0.2)
    kinds = (whole[0][2:2 + pu.N_KINDS] ** 2 * len(text.encode())).round().astype(int)
    assert kinds[2] == text.count(" ") and kinds[3] == sum(c.isdigit() for c in text)
    assert kinds[8 + pu._MARKS.index(b"!")] == text.count("!")


def test_defined_cases(spark, given):
    docs, labels = given
    odd = spark.createDataFrame([(None, None), (None, "a b c"), (77_777, ""), (77_778, " \n\t "), (77_779, "x" * 1_500_000),
                                 (77_780, "la la " * 300_000), (77_781, "twice"), (77_781, "twice")], SCHEMA)
    more = docs.select("doc_id", "text").union(odd).selectExpr("*", "1 AS x", "2 AS score", "'a' AS positive", "0 AS half")
    wild = labels.select("doc_id", "quality").union(spark.createDataFrame([(None, 1), (1, None), (1, 0), (1, 1)], "doc_id long, quality int"))
    out = pu.judge(more, wild).toPandas()
    assert len(out) == docs.count() + 8 and out.score.between(0, 1).all()
    assert out[out.doc_id.isna()].held_out.eq(False).all()
    assert out[out.doc_id == 77_781].score.nunique() == 1
    none = pu.judge(docs.limit(20), labels.limit(0)).toPandas()
    assert (none.score == 0.5).all() and (none.predicted == 1).all()
    assert pu.judge(docs.limit(0), labels).count() == 0


def test_sums_in_rounds(spark, given):
    docs, labels = given
    rows = pu.prepared(docs.limit(60), labels).repartition(70)
    _, counts = pu._scaling(rows)
    assert counts[0] == 60 and counts[1] == rows.filter("positive").count()
