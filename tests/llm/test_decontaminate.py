"""Leaks against a brute-force containment, and re-parameterised questions."""

from siltworks.llm import decontaminate
from siltworks.llm.decontaminate import OUTER, find_leaks, op8_decontaminate, split, without_leaks


def test_documents_equal_brute_force(spark):
    sf = "/root/testdata/sf0.01"

    def canon(text):
        return [w.strip(OUTER).lower() for w in split(text or "")]

    items = {r.item_id: canon(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = " " + " ".join(canon(r.text)) + " "
        want |= {(r.doc_id, i) for i, w in items.items() if " " + " ".join(w) + " " in words}
    got = {(r.doc_id, r.item_id) for r in op8_decontaminate(spark, sf).collect()}
    assert want and want <= got and len(got) <= len(want) * 1.1


QUESTION = "A train leaves Paris at 15 km per hour and after 15 minutes another train leaves Berlin at 40 km per hour toward the first"


def test_slots_nulls_blocks_and_repeats(spark, monkeypatch):
    changed = QUESTION.replace("15", "22").replace("40", "61").replace("Paris", "Madrid").replace("Berlin", "Vienna")
    mixed = changed.replace("22 minutes", "23 minutes")
    near = " ".join(QUESTION.split()[:9])
    rows = [(1, f"x y. {QUESTION}! z"), (2, f"Well: {changed}."), (3, mixed), (4, near), (5, None), (6, ""), (None, QUESTION.lower()), (1, f"x y. {QUESTION}! z"), (7, "Who is it?"), (8, "12 13 14 15 16 17 18 " * 9000)]
    docs = spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(10, QUESTION), (11, None), (12, ""), (13, "who is it"), (14, "1 2 3 4 5 6")], "item_id long, text string")
    for size in (decontaminate.INDEX_BYTES, 64):
        monkeypatch.setattr(decontaminate, "INDEX_BYTES", size)
        got = sorted(((r.doc_id, r.item_id, r.kind) for r in find_leaks(docs, bench).collect()), key=str)
        assert [g for g in got if g[1] in (10, 13)] == sorted([(1, 10, "exact"), (1, 10, "exact"), (2, 10, "reparameterised"), (7, 13, "exact")], key=str), got
        left = without_leaks(docs, bench.where("item_id <> 14"))
        assert left.columns == docs.columns and sorted((r.doc_id for r in left.collect()), key=str) == sorted([3, 4, 5, 6, None, 8], key=str)
    assert find_leaks(docs, bench.limit(0)).collect() == [] and find_leaks(docs.limit(0), bench).collect() == []


def test_shifted_windows_names_at_starts_and_edited_slots():
    def leaks(item, text):
        return [r[1] for r in decontaminate.Benchmark([(1, item)]).leaks(text)]

    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(39)]
    item = " ".join(words)
    assert leaks(item, item) == ["exact"]
    assert leaks(item, " ".join(["x", *words[:20], "new", *words[20:], "y"])) == ["exact"]  # a word put in
    assert leaks(item, " ".join(["x", *words[:20], *words[21:], "y"])) == ["exact"]  # a word left out
    assert leaks(item, " ".join(words[:20])) == [] and leaks(item, " ".join(words[20:] + words[:20])) == []
    paid = " ".join([*words[:20], "1500", *words[20:]])
    assert leaks(paid, " ".join([*words[:20], "1", "500", *words[20:]])) == ["reparameterised"]
    story = "Tom has 3 apples and gives them away. Tom buys 4 more of them today. Tom eats 2 of the red ones."
    anna = story.replace("Tom", "Anna").replace("3", "5").replace("4", "7").replace("2", "6")
    assert leaks(story, anna) == ["reparameterised"]
    assert leaks(story, anna.replace("Anna buys", "Eve buys")) == []
    twice = " ".join(["pay", "15", "now", *words, "pay", "15", "later"])
    assert leaks(twice, twice.replace("15 later", "16 later")) == ["near"]


def test_short_texts_are_looked_up_together(monkeypatch):
    """Many texts go through the arrays at once, and find what each would by itself; no window spans two of them."""
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(30)]
    item = " ".join(words)
    texts = [" ".join(words[:15]), " ".join(words[15:]), None, "", item, f"So it is. {item}!", *(f"nothing {i} of it" for i in range(400)), item]
    index = decontaminate.Benchmark([(1, item), (2, "nothing 5 of it"), (2, item), (3, "")])
    alone = [index.leaks(t) for t in texts]
    calls = []
    of = index.templates.of
    monkeypatch.setattr(index.templates, "of", lambda *a: calls.append(1) or of(*a))
    assert list(index.leaks_of(texts)) == alone and len(calls) == 1
    assert [len(own) for own in alone[:6]] == [0, 0, 0, 0, 2, 2] and all(len(own) == 1 for own in alone[6:-1])
    monkeypatch.setattr(decontaminate, "TOGETHER", 50)
    monkeypatch.setattr(decontaminate, "CACHED_WORDS", 60)
    assert list(decontaminate.Benchmark([(1, item), (2, "nothing 5 of it"), (2, item), (3, "")]).leaks_of(texts)) == alone
