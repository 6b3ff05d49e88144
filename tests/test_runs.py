"""Runs that replace earlier ones, and runs that end half way."""

from siltworks import session
from siltworks.operators import curation, runs, validation
from siltworks.plans import slate
from pyspark.sql import functions as F

SCHEMA = [("title", True, "string"), ("ofo_code", False, "string")]


def made(spark, rows):
    df = spark.createDataFrame(rows, "row_index long, dataset_id string, title string, ofo_code string, company_name string")
    return curation.evaluate(validation.validate(df, SCHEMA).withColumn("extraction_confidence", F.lit("1.000").cast("decimal(6,3)")))


FIRST = [(1, "007", "Mechanical Engineering Technician", "311501", "Acme Motor Works"), (2, "007", "Accountant", "2411", ""), (3, "b c/d", "Welder", "651202", ""), (4, None, "Nobody", "", "")]
SECOND = [(1, "007", "Accountant", "2411", ""), (5, "007", "Welder", "651202", "")]


def shown(spark, folder):
    return sorted((r.dataset_id, r.row_index, r.run_id, r.decision) for r in runs.current(spark, folder, "decisions").collect())


def test_two_runs_leave_one_set_of_decisions(spark, tmp_path):
    folder = str(tmp_path / "store")
    assert runs.last_commits(spark, folder).collect() == []
    runs.run(made(spark, FIRST), folder, "one", "occupational_relevance")
    first = shown(spark, folder)
    assert [(d, i) for d, i, _, _ in first] == [("007", 1), ("007", 2), ("b c/d", 3)]
    runs.run(made(spark, SECOND), folder, "two", "occupational_relevance")
    second = shown(spark, folder)
    # one set of decisions for the dataset that was run again, the other one as it was
    assert [(d, i, r) for d, i, r, _ in second] == [("007", 1, "two"), ("007", 5, "two"), ("b c/d", 3, "one")]
    for table in ("conflicts", "evidence"):
        kept = runs.current(spark, folder, table).select("dataset_id", "run_id").distinct().collect()
        assert {(r.dataset_id, r.run_id) for r in kept} <= {("007", "two"), ("b c/d", "one")}
    log = {(r.seq, r.row_index): (r.previous_value, r.new_value) for r in runs.ledger(spark, folder).collect()}
    before = {i: d for _, i, _, d in first}
    assert sorted(log) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 5)]
    assert log[2, 1][0] == before[1] and log[2, 5][0] == "unprocessed" and log[1, 3] == ("unprocessed", before[3])
    history = runs.commits(spark, folder).where("dataset_id = '007'").orderBy("seq").collect()
    assert [(r.seq, r.run_id, r.total) for r in history] == [(1, "one", 2), (2, "two", 2)]


def test_a_run_that_ends_before_its_commit_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "store")
    runs.run(made(spark, FIRST), folder, "one", "occupational_relevance")
    old, log = shown(spark, folder), runs.ledger(spark, folder).count()
    runs.write_tables(made(spark, SECOND), folder, "two", "occupational_relevance")
    assert shown(spark, folder) == old and runs.ledger(spark, folder).count() == log
    # tried again it replaces its own first attempt
    runs.run(made(spark, SECOND), folder, "two", "occupational_relevance")
    assert [r for _, _, r, _ in shown(spark, folder)] == ["two", "two", "one"]
    assert runs.ledger(spark, folder).count() == log + 2


def test_sweep_keeps_what_readers_follow(spark, tmp_path):
    folder = str(tmp_path / "store")
    runs.run(made(spark, FIRST), folder, "one", "occupational_relevance")
    runs.run(made(spark, SECOND), folder, "two", "occupational_relevance")
    runs.write_tables(made(spark, FIRST), folder, "half", "occupational_relevance")
    before, log = shown(spark, folder), runs.ledger(spark, folder).count()
    gone = runs.sweep(spark, folder)
    assert "decisions/run_id=one/dataset_id=007" in gone and any(g.startswith("ledger/run_id=half") for g in gone)
    assert not any(g.startswith("ledger/run_id=one") or g.startswith("decisions/run_id=two") for g in gone)
    assert shown(spark, folder) == before and runs.ledger(spark, folder).count() == log
    assert runs.sweep(spark, folder) == []


def test_nothing_to_run(spark, tmp_path):
    folder = str(tmp_path / "store")
    runs.run(made(spark, FIRST[3:]), folder, "none", "occupational_relevance")
    assert shown(spark, folder) == [] and runs.ledger(spark, folder).collect() == [] and runs.commits(spark, folder).collect() == []


def test_tables_are_written_in_tasks_of_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "ROWS", 30)
    e = slate.evaluated(spark, "/root/testdata/sf0.001")
    n = e.count()
    assert e.rdd.getNumPartitions() == -(-n // 30) > 1
    runs.run(e, str(tmp_path), "first", "p")
    runs.run(e.where("row_index % 2 = 0"), str(tmp_path), "second", "p")
    # a file holds rows of one task and one dataset
    for table in ("decisions", "evidence", "ledger"):
        files = {str(f).split("part-")[1][:5] for f in (tmp_path / table / "run_id=first").glob("*/part-*")}
        assert len(files) == -(-n // 30), table
    assert runs.ledger(spark, str(tmp_path)).count() == n + e.where("row_index % 2 = 0").count()
    kept = runs.current(spark, str(tmp_path), "decisions")
    assert kept.count() == kept.where("row_index % 2 = 0 and run_id = 'second'").count() == e.where("row_index % 2 = 0").count()
