"""Grids of many layouts: headers, records and documents of several tables."""

import pytest

from siltworks import session
from siltworks.functions import constants as K
from siltworks.operators import structure, tables
from siltworks.plans import grids
from pyspark.sql import functions as F

GRID = "table_id long, row_index long, cells array<string>, header_row string"


def grid(spark, **rows):
    return spark.createDataFrame([(int(t[1:]), i, cells, "x") for t, own in rows.items() for i, cells in enumerate(own)], GRID).drop("header_row")


def test_every_table_finds_its_own_header(spark):
    df = grid(
        spark,
        t1=[["List", None], ["TVET College", "SAQA ID", "Programme"], ["North TVET", "94021", "Welder"], [None, "", "and fitter"], ["South College;", "", None]],
        t2=[["94022", "Baker", "4", "OQSF"], ["", "of bread", "", ""], ["99", "two digits"], ["SAQA ID", "Title", "", ""], ["123", "lost", "", ""]],
        t3=[["just text"], ["1", "2"]],
        t4=[[], None, ["94023"]],
    )
    got = {r.saqa_id: r for r in tables.qualifications(df).collect()}
    assert sorted(got) == ["94021", "94022"]
    r = got["94021"]
    assert (r.table_id, r.row_index, r.header_row, r.qualification, r.participating_colleges, r.nsfas_eligible, r.confidence) == (1, 2, 1, "Welder and fitter", "North TVET; South College", "No", 0.96)
    # without a header cells go by position; the row of a repeated header and one with three digits are no records
    r = got["94022"]
    assert (r.header_row, r.qualification, r.nqf_level, r.framework, r.nsfas_eligible) == (None, "Baker of bread", "4", "OQSF", "No")
    assert tables.qualifications(df.limit(0)).collect() == []


def test_occupations_continue_by_title_only(spark):
    df = grid(spark, t1=[["OFO Code", "Occupation Title", "Priority", "Province"], ["311501", "Mechanical", "", "GP"], ["", "Technician"], ["", ""], ["x", "not a code"], ["1219", "Manager"]])
    got = [(r.ofo_code, r.occupation_title, r.demand_rank, r.province) for r in tables.occupations(df).orderBy("row_index").collect()]
    # an empty cell stays empty, a missing one takes its default
    assert got == [("311501", "Mechanical Technician", "", "GP"), ("1219", "Manager", "1", "National")]


def test_aliases_are_taken_greedily(spark):
    df = spark.createDataFrame([(["Code", "Qual ID", "Title"],), (["Sub-framework type", "x", None],), ([],), (None,)], "c array<string>")
    got = [r[0] for r in df.select(tables.places(tables.tidy(F.col("c")), K.QUALIFICATION_ALIASES)).collect()]
    # "id" and "qual id" go to the first header with any alias of the field, which is Code
    assert got[:3] == [[0, 2, -1, -1, -1, -1], [-1, -1, -1, 0, -1, -1], [-1] * 6]


@pytest.mark.parametrize("size", [3, 65_536])
def test_running_counts_over_blocks(spark, size):
    rows = [(i % 2, i, i % 3 == 0) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, i long, f boolean")
    got = {(r.k, r.i): r.n for r in structure.running_count(df, ["k"], "i", F.col("f"), "n", size=size).collect()}
    assert got == {(k, i): sum(f for k2, j, f in rows if k2 == k and j <= i) for k, i, _ in rows}


def test_documents_keep_the_first_tables_columns(spark):
    heads = spark.createDataFrame(
        [(1, 1, 0, ["SAQA ID", "Title", "College"]), (1, 2, 0, ["College name", "Programme", "SAQA"]), (2, 1, 0, ["a", "a", None]), (3, 1, 0, ["x"])], "doc long, page long, table_index long, headers array<string>")
    rows = spark.createDataFrame(
        [
            (1, 1, 0, 0, ["1001", "Welder", "North TVET"]), (1, 1, 0, 1, ["SAQA ID", "Title", "College"]),
            # the next page goes on with the last record, under other headers
            (1, 2, 0, 0, ["", "fitter", ""]), (1, 2, 0, 1, ["South", "Baker", "1002"]), (1, 2, 0, 2, ["East", "baker", ""]), (1, 2, 0, 3, [None, " ", ""]),
            (2, 1, 0, 0, ["", "only"]), (2, 1, 0, 1, ["1", "2", "3", "4"]),
        ],
        "doc long, page long, table_index long, row_index long, cells array<string>")
    got = {(r.doc, r.record_no): r for r in tables.document_records(heads, rows).collect()}
    assert sorted(got) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert got[1, 1].record == {"saqa_id": "1001", "title": "Welder fitter", "college": "North TVET"} and got[1, 1].n_rows == 2
    assert got[1, 2].record == {"saqa_id": "1002", "title": "Baker", "college": "South; East"}
    assert (got[1, 2].page, got[1, 2].row_index) == (2, 1)
    # repeated headers get numbers; a first row without an id is a record
    assert got[2, 1].record == {"a": "", "a_2": "only", "column": ""} and got[2, 2].record == {"a": "1", "a_2": "2", "column": "3"}
    assert tables.document_records(heads, rows.limit(0)).collect() == []


def test_documents_are_dealt_out_by_rows(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    whole = sorted(map(repr, grids.document_records(spark, sf).collect()))
    monkeypatch.setattr(session, "ROWS", 20)
    heads, rows = grids.document_tables(spark, sf)
    assert rows.rdd.getNumPartitions() == -(-rows.count() // 20) > 1
    found = tables.document_records(heads, rows)
    # texts made from one number look small, but are not sent whole to every task
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "table_index" in x]
    assert sorted(map(repr, grids.document_records(spark, sf).collect())) == whole


def test_the_first_row_of_a_group_counts(spark):
    df = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 9, False), ("b", 1, True), ("b", 5, True), ("c", 7, None)], "k string, i int, f boolean")
    got = {(r.k, r.i): r.n for r in structure.running_count(df, ["k"], "i", F.coalesce("f", F.lit(False)), "n", F.col("i").cast("long"), first=True).collect()}
    assert got == {("a", 1): 1, ("a", 2): 2, ("a", 9): 2, ("b", 1): 1, ("b", 5): 2, ("c", 7): 1}


@pytest.mark.parametrize("name", ["stated_contexts"])
def test_rows_of_a_table_are_dealt_out(spark, monkeypatch, name):
    sf = "/root/testdata/sf0.001"
    ask = getattr(grids, name)
    whole = sorted(map(repr, ask(spark, sf).collect()))
    monkeypatch.setattr(session, "ROWS", 60)
    assert "REPARTITION_BY_NUM" in ask(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(repr, ask(spark, sf).collect())) == whole
