"""Classes of similar documents against brute force over all pairs."""

import random
import re

from siltworks.llm.jaccard_join import op7_jaccard_join, similar_classes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, size=4, num=85, den=100):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        k = min(size, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and min(len(a), len(sets[j])) * den >= num * max(len(a), len(sets[j])):
                both = len(a & sets[j])
                if both * den >= num * (len(a) + len(sets[j]) - both):
                    up[top(i)] = top(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids, default=None)))
    return out


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows)
    assert sorted(tuple(r) for r in op7_jaccard_join(spark, sf).collect()) == sorted(want)
    assert sum(d != c for d, _, c in want) > 20


def test_chains_short_texts_nulls_and_repeats(spark, monkeypatch):
    import siltworks.llm.jaccard_join as module

    monkeypatch.setattr(module, "COMMON", 5)
    monkeypatch.setattr(module, "BLOCK", 16)
    rng = random.Random(8)
    rows = [(None, "a b"), (1, None), (1, ""), (2, "A B"), (3, "a b"), (3, "a b"), (4, "a"), (5, "é É"), (6, "x " * 50_000), (7, "X\n" * 40_000), (None, "only here and no where else")]
    words = [f"w{i}" for i in range(400)]
    for c in range(3):  # each text differs a little from the one before, so that classes are chains
        text = rng.choices(words, k=60 + 40 * c)
        for i in range(30):
            text = list(text)
            text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((100 * c + 10 + i, " ".join(text)))
    base = [f"h{i}" for i in range(120)]
    for i in range(60):  # a crowd of near copies
        text = list(base)
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(120)] = rng.choice(words)
        rows.append((1000 + i, " ".join(text)))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int")
    got = similar_classes(df).drop("__row")
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    want = brute(rows)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert similar_classes(df.limit(0)).collect() == []


def test_common_shingles_in_one_text_of_a_pair(spark):
    rng = random.Random(3)
    rows = [(i, f"this text is free {' '.join(f'u{i}x{k}' for k in range(6))}") for i in range(150)]
    for i in range(30):  # only the second text of a pair holds the shingle that 150 documents share
        text = " ".join(f"w{rng.randrange(10_000)}" for _ in range(100))
        rows += [(1000 + 2 * i, text), (1001 + 2 * i, text + " this text is free")]
    got = similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).drop("__row")
    want = brute(rows)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sum(d != c for d, _, c in want) == 30
