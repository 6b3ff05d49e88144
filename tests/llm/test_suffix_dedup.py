"""Suffix arrays, common prefixes and byte dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np

from siltworks.llm.suffix_dedup import common_prefixes, dedup_bytes, op2_suffix_dedup, suffix_array


def test_suffix_array_and_prefixes():
    rng = random.Random(2)
    for k in range(300):
        size = rng.choice([2, 3, 5, 258, 3000])
        body = [rng.randint(1, size - 1) for _ in range(rng.randint(0, 60))] * rng.choice([1, 1, 3])
        text = np.array([*body, 0], np.int64)
        order = suffix_array(text, size)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        shared, before = common_prefixes(text.astype(np.uint16), order)
        for i, b in enumerate(before.tolist()):
            want = 0
            while b >= 0 and i + want < len(text) and b + want < len(text) and text[i + want] == text[b + want]:
                want += 1
            assert shared[i] == want


def brute(rows, window):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for (doc, _), d in zip(rows, data):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                gone[i : i + window] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((doc, len(d), int(gone.sum()), spans, np.frombuffer(d, np.uint8)[~gone].tobytes()))
    return out


def test_query_equals_brute_force_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(*w[:4], hashlib.sha256(w[4]).hexdigest()) for w in brute(rows, 400)]
    got = [tuple(r) for r in op2_suffix_dedup(spark, sf).collect()]
    assert sorted(got) == sorted(want) and sum(w[2] for w in want) > 1000


def test_small_windows_periods_nulls_and_repeats(spark):
    rng = random.Random(3)
    base = "".join(rng.choices("abcé ", k=400))
    rows = [(None, base), (1, None), (1, ""), (1, ""), (2, "é" * 300), (3, "x" * 20_000), (4, "ab" * 500 + "c"), (4, "ab" * 500 + "c"), (5, base[:39])]
    for doc in range(6, 40):
        a, b = rng.randint(0, 300), rng.randint(0, 300)
        rows.append((doc, base[a : a + rng.randint(20, 90)] + "".join(rng.choices("abcd", k=rng.randint(0, 50))) + base[b : b + rng.randint(0, 60)]))
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, Kept int, c0 int")
    got = dedup_bytes(df, window=40)
    assert got.columns == ["doc_id", "text", "c0", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()), key=str) == sorted(brute(rows, 40), key=str)
    assert dedup_bytes(df.limit(0)).collect() == []
