"""Pages of files: parsers, damaged files, and what is pushed into the scan."""

import gzip
import io
import json

import pytest

from siltworks.sources import paged as P
from pyspark.sql import functions as F


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("one\ftwo é\f \fa|b\nc|d\n".encode())
    (tmp_path / "sub" / "b.gz").write_bytes(gzip.compress(b"zipped\fmore"))
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps({"page": i, "text": f"p{i}"}) for i in (1, 2, 3)) + "\n")
    (tmp_path / "broken.gz").write_bytes(gzip.compress(b"x" * 5000)[:-9])
    (tmp_path / "latin.txt").write_bytes(b"caf\xe9\fmore")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"no")
    return str(tmp_path)


def rows(df, folder):
    return sorted((r.path.removeprefix(folder + "/"), r.page, r.text, r.has_text, r.parser) for r in df.where("error is null").collect())


def test_each_file_by_the_first_parser_that_reads_it(spark, folder):
    df = P.pages(spark, folder)
    assert rows(df, folder) == sorted([
        ("a.txt", 1, "one", True, "text"), ("a.txt", 2, "two é", True, "text"), ("a.txt", 3, " ", False, "text"), ("a.txt", 4, "a|b\nc|d\n", True, "text"), ("sub/b.gz", 1, "zipped", True, "gzip"), ("sub/b.gz", 2, "more", True, "gzip"),
        ("c.jsonl", 1, "p1", True, "json"), ("c.jsonl", 2, "p2", True, "json"), ("c.jsonl", 3, "p3", True, "json"), ("empty.txt", 1, "", False, "text")])
    failed = {r.path.removeprefix(folder + "/"): r for r in df.where("error is not null").collect()}
    assert sorted(failed) == ["broken.gz", "latin.txt"]
    assert failed["broken.gz"].page is None and "gzip:" in failed["broken.gz"].error and "text:" in failed["broken.gz"].error
    # a fallback that is asked for
    lenient = P.pages(spark, folder, "gzip,json,text,lenient").where("path like '%latin.txt'")
    assert [(r.page, r.text, r.parser) for r in lenient.orderBy("page").collect()] == [(1, "caf�", "lenient"), (2, "more", "lenient")]


def test_ranges_reach_the_files(spark, folder):
    df = P.pages(spark, folder).where("page between 2 and 3")
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [GreaterThanOrEqual(page,2), LessThanOrEqual(page,3)]" in plan
    # nothing is left to filter but nulls
    assert "Condition : isnotnull(page" in plan
    assert [r[:2] for r in rows(df, folder)] == [("a.txt", 2), ("a.txt", 3), ("c.jsonl", 2), ("c.jsonl", 3), ("sub/b.gz", 2)]
    one = P.pages(spark, folder).where(F.col("path") == f"{folder}/a.txt").where("page < 2")
    assert [r[:2] for r in rows(one, folder)] == [("a.txt", 1)]


def test_a_reader_stops_after_the_last_page():
    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            Counted.taken += len(out)
            return out

    data = b"first\f" + b"x" * (8 * P.CHUNK)
    assert list(P.text_pages(Counted(data), 1)) == [(1, "first")] and Counted.taken <= P.CHUNK
    reader = P.PagesReader("x", ["text"])
    left = list(reader.pushFilters([P.GreaterThan(("page",), 1), P.LessThanOrEqual(("page",), 4), P.EqualTo(("text",), "a")]))
    assert (reader.first, reader.last) == (2, 4) and [f.attribute for f in left] == [("text",)]


def test_small_files_share_partitions(folder, monkeypatch):
    assert [len(p.paths) for p in P.PagesReader(folder, ["text"]).partitions()] == [6]
    monkeypatch.setattr(P, "PARTITION_FILES", 2)
    assert [len(p.paths) for p in P.PagesReader(folder, ["text"]).partitions()] == [2, 2, 2]
    with pytest.raises(FileNotFoundError):
        P.PagesReader(folder + "/none", ["text"]).partitions()


def test_facts_of_files(spark, folder):
    got = {r.path.removeprefix(folder + "/"): r for r in P.file_facts(P.pages(spark, folder)).collect()}
    a = got["a.txt"]
    assert (a.page_count, a.has_text_layer, a.preview, a.sample_text, a.table_count, a.error) == (4, True, "one", True, 1, None)
    assert (got["empty.txt"].page_count, got["empty.txt"].has_text_layer, got["broken.gz"].page_count, got["broken.gz"].error is None) == (1, False, 0, False)


def test_first_attempt_with_rows_counts(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,), (3,)], "doc int")
    special, generic = spark.createDataFrame([(1, "s"), (1, "t")], "doc int, a string"), spark.createDataFrame([(1, "g"), (2, "g"), (None, "x")], "doc int, b string")
    kept, outcome = P.with_fallback(docs, [("qualifications", special), ("generic", generic)])
    assert sorted((r.doc, r.extractor, r.a, r.b) for r in kept.collect()) == [(1, "qualifications", "s", None), (1, "qualifications", "t", None), (2, "generic", None, "g")]
    assert sorted((r.doc, r.extractor, r.error is None) for r in outcome.collect()) == [(1, "qualifications", True), (2, "generic", True), (3, None, False)]
    named = spark.createDataFrame([("TVET list", "auto"), ("x", "OIHD"), ("qualifications", "generic"), ("survey", None), ("email", "auto"), (None, None)], "k string, p string")
    assert [r[0] for r in named.select(P.chosen_extractor(F.col("k"), F.col("p"))).collect()] == ["qualifications", "occupations", "generic", "codebook", "llm", "generic"]
