"""Divergence of sources against a plain recount."""

import re
from collections import Counter, defaultdict

import numpy as np

from siltworks.llm import source_audit as S

SCHEMA = "doc_id long, text string, lang string, source string, term string, value long"


def brute(rows, min_docs=2, top=50):
    docs = [(lang or "", source or "", Counter(t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""))) for _, text, lang, source, *_ in rows]
    seen, by_lang, by_group = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        seen[lang].update(terms.keys())
        by_lang[lang].update(terms)
        by_group[lang, source].update(terms)
    out = []
    share = lambda c, n, v: 1 + 10**9 * (c + 5) // (n + 5 * v)
    for lang in by_lang:
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        v = len(kept)
        own = {s: {t: c[t] for t in kept} for (g, s), c in by_group.items() if g == lang}
        p = {s: {t: share(c[t], sum(c.values()), v) for t in kept} for s, c in own.items()}
        q = {t: share(by_lang[lang][t], sum(by_lang[lang][x] for x in kept), v) for t in kept}
        for s in own:
            parts = {"pair": [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s], "term": [(p[s][t] - q[t], t) for t in kept if own[s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, n + 1) for n, (value, item) in enumerate(items) if part == "pair" or n < top]
    return sorted(out)


def test_equals_a_recount_over_blocks_and_chunks(spark):
    rng = np.random.default_rng(12)
    words = [f"{a}{b}" for a in "abcdéfgßhI" for b in "xyzÄ一"]
    rows = [(i, " ".join(words[k] for k in (rng.zipf(1.5, 40) + i) % len(words)) + ". The-the\x00THE 12", ["en", "de"][i % 2], f"s{rng.integers(9)}", "t", 1) for i in range(120)]
    rows += [(200, None, "en", "s1", "", 0), (201, "Alone", "xx", None, "", 0), (201, "Alone", "xx", None, "", 0), (202, "", None, None, "", 0), (203, "a b", None, "z", "", 0), (204, "x" * 300_000 + " q" * 300_000, "en", "s0", "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert any(r[4] == 0 for r in want)  # a language without kept terms
    assert sorted(map(tuple, S.divergence(df, min_docs=2).collect())) == want
    assert sorted(map(tuple, S.divergence(df, min_docs=2, chunks=7, block=2).collect())) == want
    assert S.divergence(df.limit(0)).collect() == []


def test_parts_are_merged(spark, monkeypatch):
    monkeypatch.setattr(S, "HELD", 2000)
    monkeypatch.setattr(S, "ROWS", 5)
    rows = [(i, f"a b{i % 3} c{i % 7} a", "en", f"s{i % 4}", "", 0) for i in range(90)]
    assert sorted(map(tuple, S.divergence(spark.createDataFrame(rows, SCHEMA).repartition(3), min_docs=2, chunks=2, block=3).collect())) == brute(rows)


def test_long_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 10)
    text = "Über straße, ÉTÉ was-was 日本語x " * 50
    assert S.terms_of(text) == Counter(t.encode() for t in ["Über", "straße", "ÉtÉ", "was", "was", "日本語x"] * 50)
    assert S.terms_of("") == Counter()


def test_shares_are_exact():
    rng = np.random.default_rng(13)
    count = rng.integers(0, 10**14, 500)
    total = count + rng.integers(0, 10**15, 500)
    terms = rng.integers(1, 10**9, 500)
    want = [1 + 10**9 * (int(c) + 5) // (int(n) + 5 * int(v)) for c, n, v in zip(count, total, terms)]
    assert S.shares(count, total, terms).tolist() == want
