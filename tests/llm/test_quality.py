"""The classifier on held-out labels, and its edge cases."""

import numpy as np
from pyspark.sql import functions as F

from siltworks.llm.quality import THRESHOLD, fit, monotone, op4_quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = op4_quality(spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = out.where("held_out").join(labels, "doc_id").collect()
    right = np.mean([r.predicted == r.quality for r in rows])
    assert len(rows) > 50 and right > 0.93, right
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= THRESHOLD) for r in rows)


def test_monotone_equals_definition():
    rng = np.random.default_rng(1)
    for _ in range(30):
        s, y = rng.permutation(12).astype(float), rng.integers(0, 2, 12).astype(float)
        knots, levels = monotone(s, y)
        o = y[np.argsort(s)]
        want = [max(min(o[i : j + 1].mean() for j in range(k, 12)) for i in range(k + 1)) for k in range(12)]
        assert (np.diff(levels) > 0).all() and set(np.round(levels, 9)) == set(np.round(want, 9))


def test_no_labels_one_label_nulls_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "good text", 3), (2, None, 3), (None, "", 3), (2, "x " * 100_000, 3)], "doc_id long, text string, Score int").withColumn("c0", F.lit(0))
    none = spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = fit(docs, none).score(docs)
    assert got.columns == ["doc_id", "text", "c0", "score", "predicted"]
    assert [r.score for r in got.collect()] == [0.5] * 4
    one = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in fit(docs, one).score(docs).collect()} == {1.0}
    assert fit(docs, none).score(docs.limit(0)).collect() == []
