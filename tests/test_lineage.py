"""States as of a time against a plain search, and the steps of a record."""

import random
from datetime import datetime, timedelta

import pytest

from siltworks.operators import lineage as L
from pyspark.sql import functions as F

BASE = datetime(2024, 3, 1)


@pytest.mark.parametrize("block", ["YEAR", "HOUR"])
def test_as_of_equals_a_search(spark, block):
    rng = random.Random(8)
    # key 1 holds most of the rows; times tie often
    changes = [(rng.choice([1, 1, 1, 2, 3, None]), BASE + timedelta(minutes=20 * rng.randint(0, 200)) if rng.random() < 0.97 else None, i, rng.choice(["a", "b", None])) for i in range(400)]
    points = [(i, rng.choice([1, 1, 2, 4, None]), BASE + timedelta(minutes=20 * rng.randint(-5, 210)) if rng.random() < 0.95 else None) for i in range(150)] + [(0, 1, BASE)] * 2
    c = spark.createDataFrame(changes, "k int, at timestamp, seq int, value string")
    p = spark.createDataFrame(points, "id int, k int, at timestamp")
    got = sorted(map(tuple, L.as_of(p, c, "k", "at", "seq", ["seq", "value"], block).collect()), key=repr)

    def last(k, at):
        own = [(t, s, v) for k2, t, s, v in changes if k is not None and at is not None and k2 == k and t is not None and t <= at]
        return max(own, key=lambda x: x[:2])[1:] if own else (None, None)

    assert got == sorted(((i, k, at, *last(k, at)) for i, k, at in points), key=repr)
    assert L.as_of(p.limit(0), c, "k", "at", "seq", ["value"]).collect() == []
    assert {tuple(r)[3:] for r in L.as_of(p, c.limit(0), "k", "at", "seq", ["value"]).collect()} == {(None,)}


def test_clashing_columns_are_refused(spark):
    p = spark.createDataFrame([(1, BASE, "x")], "k int, at timestamp, value string")
    with pytest.raises(ValueError, match="value"):
        L.as_of(p, p.withColumn("seq", F.lit(1)), "k", "at", "seq", ["value"])


def test_steps_and_ledger_in_order(spark):
    rows = [(1, "valid", "INCLUDE", None, ""), (2, "human_reviewed", "REVIEW", "low_confidence", "looks right"), (3, "error", None, None, None)]
    e = spark.createDataFrame(rows, "id int, status string, decision string, reason_code string, notes string")
    made = L.steps(e, "id", F.lit(4), F.lit("table"), F.col("id") == 1, F.when(F.col("status") == "error", 2).otherwise(0), F.col("notes"), F.lit(BASE), F.lit(BASE + timedelta(days=1)))
    log = spark.createDataFrame([(2, BASE, 9, "REVIEW", "ann", None, "INCLUDE"), (2, BASE - timedelta(days=1), 10, "REVIEW", "bo", "INCLUDE", "REVIEW"), (7, BASE, 1, "REVIEW", "c", "", "")], "id int, at timestamp, seq int, stage string, actor string, previous_value string, new_value string")
    got = {}
    for r in sorted(L.with_ledger(made, log, "id", "at", "seq").collect(), key=lambda r: (r.id, r.step)):
        got.setdefault(r.id, []).append((r.step, r.stage, r.status, r.detail))
    assert [s[1] for s in got[1]] == ["EXTRACTION", "NORMALIZATION", "CURATION", "VALIDATION"]
    assert got[1][1][3] == "values changed" and got[3][2][2] == "unprocessed" and got[3][3] == (4, "VALIDATION", "warning", "2 issues")
    assert got[2][4:] == [(5, "HUMAN_REVIEW", "approved", "looks right"), (6, "REVIEW", "recorded", "INCLUDE -> REVIEW"), (7, "REVIEW", "recorded", " -> INCLUDE")]
    assert 7 not in got
