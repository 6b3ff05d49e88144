"""The pipeline's stages against the operators' brute-force versions, one after the other."""

from tokenizers import Tokenizer

import corpus_pipeline
from siltworks.llm.bpe import word_vocabulary

from . import test_jaccard_join, test_line_dedup
from .test_decontaminate import OUTER, split


def test_stages_equal_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out[name] = {r.doc_id: r for r in docs.collect()}
        if name != "bpe":
            assert docs.columns == columns
    source = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = out["quality"]
    good = [d for d, q in labels.items() if q == 1]
    bad = [d for d, q in labels.items() if q == 0]
    assert sum(d in kept for d in good) >= 0.9 * len(good) and sum(d in kept for d in bad) <= 0.15 * len(bad) + 1
    assert all(r == source[d] for d, r in kept.items())
    rows = [(d, r.text) for d, r in kept.items()]
    want = {d: t for d, t in test_line_dedup.brute(rows).items() if t.strip(" ")}
    assert {d: r.text for d, r in out["line_dedup"].items()} == want
    assert all(r.n_chars == len(r.text) for r in out["line_dedup"].values())
    classes = test_jaccard_join.brute(sorted(want.items()), 5, 80, 100)
    assert set(out["jaccard_join"]) == {d for d, _, c in classes if d == c}
    items = [" ".join(w.strip(OUTER).lower() for w in split(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for d, r in out["jaccard_join"].items():
        text = " ".join(w.strip(OUTER).lower() for w in split(r.text))
        if any(f" {i} " in f" {text} " for i in items):
            assert d not in out["decontaminate"]
    assert len(out["decontaminate"]) >= 0.8 * len(out["jaccard_join"])
    library = Tokenizer.from_file(word_vocabulary())
    for d, r in out["bpe"].items():
        ids = library.encode(out["decontaminate"][d].text, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)
    ran = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf).collect()}
    assert ran == {d: r.n_tokens for d, r in out["bpe"].items()}


def test_stages_take_nulls_repeats_and_extra_columns(spark):
    sf = "/root/testdata/sf0.001"
    text = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars between 900 and 3000").orderBy("doc_id").first().text
    rows = [(1, text, "en", "b", 5), (1, text, "en", "a", 5), (None, text, None, None, None), (2, None, "en", "a", 0), (3, "", "en", "a", 0), (None, None, None, None, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).collect() == [], name
    lines = stages["line_dedup"](spark, docs, sf).collect()
    assert sorted(str(r.doc_id) for r in lines if r.text) == ["None"] and sum(r.text is None for r in lines) == 2
    one = stages["jaccard_join"](spark, docs, sf)
    assert one.columns == docs.columns
    assert sorted(str((r.doc_id, r.source)) for r in one.collect() if r.text) == ["(1, 'a')"]
    assert stages["decontaminate"](spark, docs, sf).columns == docs.columns
    assert {r.n_tokens for r in stages["bpe"](spark, docs.where("text is null or text = ''"), sf).collect()} == {0}
