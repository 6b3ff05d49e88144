"""Known decision cases, duplicate classes, quality figures and order-sensitive operators."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions import text as X
from siltworks.operators import curation, duplicates, quality, relational, structure, validation
from siltworks.sources import readers, writers
from siltworks.streaming import ingest


def test_decision_cases(spark):
    rows = [
        (1, "Accountant", "2411", "Auto Motor Plant"), (2, "Mechanical Engineering Technician", "3115", ""), (3, "Operations Manager", "1219", ""),
        (4, "Assembly Technician Assembler", "7211", ""), (5, "Cleaner", "8112", "Tyre Works"), (6, "Bookkeeper", "2144", ""),
    ]
    df = spark.createDataFrame(rows, "row_index long, title string, ofo_code string, company_name string").withColumns(
        {"status": F.lit("valid"), "extraction_confidence": F.lit("1").cast("decimal(6,3)"), "dataset_id": F.lit("d")})
    got = {r.row_index: r for r in curation.evaluate(df).collect()}
    assert [got[i].decision for i in range(1, 7)] == ["EXCLUDE", "INCLUDE", "REVIEW", "INCLUDE", "EXCLUDE", "REVIEW"]
    assert [str(got[i].overall_confidence) for i in range(1, 7)] == ["0.739", "0.965", "0.759", "0.965", "0.739", "0.679"]
    assert str(got[2].curation_confidence) == "0.915" and got[3].reason_code == "ambiguous_evidence" and got[6].priority == "critical"


def test_duplicate_classes(spark):
    rows = [(1, "Mechanical Engineering Technician"), (2, "Mechanical Engineering Technologist"), (3, "Welder"), (4, "welder."), (5, None), (60, "Welder")]
    got = {(r.i, r.j): (r.duplicate_type, r.similarity) for r in duplicates.similar_pairs(spark.createDataFrame(rows, "row_index long, title string")).collect()}
    assert got[(1, 2)] == ("LEGITIMATE_RELATED_RECORD", 0.6765) and got[(3, 4)] == ("EXACT_DUPLICATE", 1.0) and len(got) == 2


def test_window_pairs_equal_the_loop(spark):
    rows = [(i, f"t{i}") for i in range(200)]
    got = {(r.i, r.j) for r in duplicates.window_pairs(spark.createDataFrame(rows, "row_index long, title string")).collect()}
    assert got == {(i, j) for i in range(200) for j in range(i + 1, min(200, i + 50))}


def test_quality_figures(spark):
    counts = spark.createDataFrame([(100, 95, 1, 4, 5, 2, 0, 0, 0, 0), (0,) * 10], " long, ".join(quality.COUNTS) + " long")
    scored = {r.total: r for r in quality.gates(quality.dimensions(counts)).collect()}
    assert str(scored[100].overall) == "98.15" and scored[100].validation_gate == "warning"
    assert str(scored[0].overall) == "100.00" and scored[0].export_status == "PRODUCTION_READY"


def test_validators(spark):
    rows = [("2021-112101",), ("112101",), ("1121",), ("INVALID_CODE",), ("12",), ("",)]
    df = validation.validate(spark.createDataFrame(rows, "ofo_code string"), [("ofo_code", False, "string")])
    assert [r.status for r in df.collect()] == ["valid"] * 3 + ["error"] * 2 + ["valid"]
    assert [r[0] for r in spark.createDataFrame([("Level 5",), ("NQF 15",)], "n string").select(X.nqf_level(F.col("n"))).collect()] == [5, None]


def test_stitching_and_filling(spark):
    rows = [(1, 1, "", "lost start"), (1, 2, "100", "North TVET"), (1, 3, "", "Orbit College"), (1, 4, "", "north tvet"), (1, 5, "", ""), (1, 6, "200", "A; B"), (1, 7, "", "C")]
    df = spark.createDataFrame(rows, "doc int, n int, id string, colleges string")
    got = [(r.id, r.colleges) for r in structure.stitch(df, "id", ["colleges"], ["doc"], ["n"], ["colleges"]).orderBy("record").collect()]
    assert got == [("", "lost start"), ("100", "North TVET; Orbit College"), ("200", "A; B; C")]
    filled = structure.fill_forward(df, "id", ["doc"], ["n"]).orderBy("n")
    assert [r.id for r in filled.collect()] == [None, "100", "100", "100", "100", "200", "200"]


def test_decomposition(spark):
    rows = [(1, "K1", "B; a ;b"), (2, "", "A;C"), (3, "K1", "")]
    df = spark.createDataFrame(rows, "row_index long, pk string, items string")
    dims = relational.dimension(df, "items")
    assert [(r.item_id, r.item) for r in dims.orderBy("item_id").collect()] == [("DIM-0001", "B"), ("DIM-0002", "a"), ("DIM-0003", "C")]
    assert relational.junction(df, dims, "items").count() == 4
    issues = {(r.row_index, r.issue) for r in relational.review(df, "pk", [], "items", "^K").collect()}
    assert issues == {(1, "repeated_item"), (3, "duplicate_key"), (3, "empty_list")}


def test_unicode_headers_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("ﬁne “x”​ – Ⅳ",)], "t string")
    assert df.select(X.clean_unicode(F.col("t"))).first()[0] == 'fine "x" - IV'
    grid = spark.createDataFrame([(1, 1, ["OFO Code", "Occupation Title"]), (1, 2, ["3115", "Welder"]), (1, 3, ["", ""])], "doc int, n int, cells array<string>")
    got = readers.with_headers(grid, ["doc"], ["n"]).collect()
    assert [(r.cells, r.headers) for r in got] == [(["3115", "Welder"], ["OFO Code", "Occupation Title"])]
    assert writers.write_package({"a b": df, "c": df.limit(0)}, str(tmp_path), "parquet") == {"a b": 1, "c": 0}
    (tmp_path / "f").mkdir()
    (tmp_path / "f/x.txt").write_text("one\ftwo")
    assert [(r.page_number, r.text) for r in readers.text_pages(spark, str(tmp_path / "f")).orderBy("page_number").collect()] == [(1, "one"), (2, "two")]


def test_incremental_ingest(spark, tmp_path):
    schema = T.StructType([T.StructField("title", T.StringType())])
    for batch in (["a", ""], ["b"]):
        spark.createDataFrame([(t,) for t in batch], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.ingest(spark, str(tmp_path / "in"), schema, [("title", True, "string")], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.title, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("", "error"), ("a", "valid"), ("b", "valid")]
