import zlib

import numpy as np
import pytest

from leadloom.llm import quality as Q


def test_isotonic_pools_violators():
    knots = Q.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]), np.array([1.0, 1.0, 1.0, 2.0]))
    assert np.allclose(knots, [[0.1, 0.0], [0.25, 0.5], [0.4, 1.0]])


def test_random_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, len(Q.STATS)))
    z = Q.Model(np.zeros(len(Q.STATS)), np.ones(len(Q.STATS))).features(x)[:, :-1]
    gap = ((x[:, None] - x[None]) ** 2).sum(2)
    assert np.abs(z @ z.T - np.exp(-gap / 2 / (Q.WIDTH**2 * len(Q.STATS)))).max() < 0.3


@pytest.mark.parametrize("text", ["", " ", "\n\n", "a", "é" * 10, "x" * 100_000, "a b " * 30_000, "\x00", "!!!"])
def test_stats_are_finite(text):
    assert len(Q.stats(text)) == len(Q.STATS) and np.isfinite(Q.stats(text)).all()


def rows(spark, n=400):
    good, bad = "the quick brown fox jumps over the lazy dog and goes home. ", "BUY!!! NOW$$$ %%% ### "
    data = [(i, (good if i % 3 else bad) * (1 + i % 5), "en", 0.1) for i in range(n)] + [(None, None, None, None), (5, "", "x", None), (5, "", "x", None)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, score double").repartition(3)


def test_learns_and_keeps_columns(spark):
    docs = rows(spark)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 400, 2)] + [(0, 0, 1), (1, None, 0), (None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    kept = Q.kept(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect() if r.text]
    assert {i % 3 for i in ids} == {1, 2} and len(ids) == sum(i % 3 > 0 for i in range(400))


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = rows(spark, 5)
    assert Q.kept(docs, none).count() == docs.count()
    assert Q.kept(docs.limit(0), none).count() == 0


def test_query_holds_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in Q.op2_quality(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()
    assert set(got) == {d.doc_id for d in docs} and len(got) == len(docs)
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    good, bad = ([g.score for g, q in held if q == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert np.mean([g.predicted == q for g, q in held]) > 0.93
