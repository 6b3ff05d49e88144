"""Substring dedup against brute force."""

import hashlib
import random
import re

from siltworks.llm.substring_dedup import dedup_substrings, op1_substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=13):
    first, split = {}, [WORD.findall(t or "") for _, t in rows]
    for (doc, _), words in zip(rows, split):
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = []
    for (doc, _), words in zip(rows, split):
        gone = set()
        for i in range(len(words) - window + 1):
            if doc is not None and first[tuple(words[i : i + window])] < doc:
                gone.update(range(i, i + window))
        out.append((doc, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def ordered(rows):
    return sorted(rows, key=str)


def test_query_equals_brute_force_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(rows)]
    got = [tuple(r) for r in op1_substring_dedup(spark, sf).collect()]
    assert ordered(got) == ordered(want) and sum(w[2] for w in want) > 1000


def test_repeats_nulls_odd_spaces_and_long_texts(spark):
    rng = random.Random(1)
    base = ["".join(rng.choices("abé", k=rng.randint(1, 3))) for _ in range(60)]
    rows = [(None, " ".join(base)), (1, None), (1, ""), (2, "x " * 30_000), (3, "x\t" * 30_000), (3, "x " * 30_000), (2, "x " * 30_000)]
    for doc in range(4, 60):
        a = rng.randint(0, 40)
        words = rng.choices(base, k=rng.randint(0, 20)) + base[a : a + rng.randint(0, 30)] + rng.choices(["of", "the"], k=rng.randint(0, 30))
        rows.append((doc, rng.choice([" ", "\n", " \x0b\r", "\x1c ", "\xa0 "]).join(words)))
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, kept int, c0 int")
    got = dedup_substrings(df)
    assert got.columns == ["doc_id", "text", "c0", "n_words", "n_removed", "spans", "kept"]
    assert ordered((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == ordered(brute(rows))
    assert dedup_substrings(df.limit(0)).collect() == []
