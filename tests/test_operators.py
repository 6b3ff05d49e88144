"""Coverage of parts, deletions over levels, rules as rows, stated counts, groups of tables and generic columns."""

import pytest

from siltworks.functions import constants as K
from siltworks.operators import audit, discovery, ledger, quality, structure, validation
from pyspark.sql import functions as F


def test_coverage_of_parts_is_that_of_the_whole(spark):
    rows = [(i, f"d{i % 2}", [f"v{i % 40}", " ", None][i % 3], f"v{i % 41}") for i in range(600)]
    df = spark.createDataFrame(rows, "i int, dataset_id string, a string, raw string")
    whole = audit.coverage_report(audit.coverage(df, {"a": "raw", "raw": None}))
    for parts in (1, 4):
        cut = [audit.coverage(df.where(F.col("i") % parts == k), {"a": "raw", "raw": None}) for k in range(parts)]
        both = cut[0]
        for c in cut[1:]:
            both = both.unionByName(c)
        assert sorted(map(tuple, audit.coverage_report(audit.merged_coverage(both)).collect())) == sorted(map(tuple, whole.collect()))
    r = whole.where("dataset_id = 'd0' and column = 'a'").first()
    own = [(a, raw) for i, d, a, raw in rows if d == "d0"]
    filled = [(a, raw) for a, raw in own if a and a.strip()]
    assert (r.total, r.filled, r.changed, float(r.coverage_pct)) == (len(own), len(filled), sum(a != raw for a, raw in filled), round(100 * len(filled) / len(own), 1))
    assert abs(r.distinct_estimate - len({a for a, _ in filled})) <= 2


@pytest.mark.parametrize("cut", ["i % 3 = 0", "i < 20"])
def test_coverage_of_many_values_is_that_of_the_whole(spark, cut):
    df = spark.range(5000).selectExpr("id as i", "0 as dataset_id", "concat('K', id) as a").coalesce(1)
    estimates = [
        audit.coverage_report(c).first().distinct_estimate for c in (
            audit.coverage(df, {"a": None}), audit.coverage(df.repartition(5, "i"), {"a": None}),
            audit.merged_coverage(audit.coverage(df.where(cut), {"a": None}).unionByName(audit.coverage(df.where(f"not ({cut})"), {"a": None}))))]
    assert len(set(estimates)) == 1 and abs(estimates[0] - 5000) < 500


def test_deletions_follow_any_number_of_levels(spark):
    tree = [("p", None, "project"), ("d1", "p", "dataset"), ("d2", "p", "dataset"), ("c", "d1", "document"), ("r1", "c", "record"), ("r2", "c", "record"), ("x", "gone", "record"), (None, "c", "record")]
    nodes = spark.createDataFrame(tree, "id string, parent string, kind string")

    def gone(*ids):
        return {r.id: r.depth for r in ledger.cascade_levels(nodes, spark.createDataFrame([(i,) for i in ids], "id string")).collect()}

    assert gone("d1") == {"d1": 0, "c": 1, "r1": 2, "r2": 2, None: 2}
    # what is deleted itself counts from there
    assert gone("p", "c", "c", "unknown", None) == {"p": 0, "d1": 1, "d2": 1, "c": 0, "r1": 1, "r2": 1, None: 1}
    assert gone() == {}
    counts = {r.kind: tuple(r)[1:] for r in ledger.recount(nodes.where("id is not null"), ledger.cascade_levels(nodes, nodes.where("id = 'd1'"))).collect()}
    assert counts == {"project": (1, 0, 0), "dataset": (2, 1, 1), "document": (1, 1, 0), "record": (3, 2, 0)}


def test_a_chain_longer_than_the_usual_limits(spark):
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    chain = spark.createDataFrame([(str(i), str(i - 1), "n") for i in range(60)], "id string, parent string, kind string")
    assert ledger.cascade_levels(chain, chain.where("id = '0'")).agg(F.max("depth")).first()[0] == 59
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == limit


def test_a_rule_is_a_row(spark):
    records = spark.createDataFrame([(1, "5", "a"), (2, " ", None), (3, "x", "b"), (4, "NaN", "c"), (5, "41", "a ")], "id int, n string, `odd name` string")
    rows = [("n", "range", "warning", False, None, 1.0, 40.0, None), ("n", "needed", "error", True, None, None, None, None), ("odd name", "known", "error", None, None, None, None, ["a", "b"]), ("nowhere", "x", "error", True, None, None, None, None)]
    rules = spark.createDataFrame(rows, validation.RULES)
    got = sorted((r.id, r.column, r.rule) for r in validation.issues_by_rules(records, "id", rules).collect())
    assert got == [(2, "n", "needed"), (3, "n", "range"), (4, "n", "range"), (4, "odd name", "known"), (5, "n", "range")]
    # one more row is one more rule
    more = rules.unionByName(spark.createDataFrame([("n", "digits", "info", None, "[0-9]", None, None, None)], validation.RULES))
    assert {r.id for r in validation.issues_by_rules(records, "id", more).where("rule = 'digits'").collect()} == {3, 4, 5}
    assert validation.issues_by_rules(records, "id", rules.limit(0)).collect() == []


def test_stated_counts_are_shown_where_they_come_first(spark):
    pages = [(1, 2, "x" * 50 + " total 12 items\nand more of it, more than forty characters of it"), (1, 1, "Mapped all 167 occupations. é 12 oihd 12 OIHD"), (1, 3, None), (2, 1, "subtotal 9 items, total 5 items"), (2, 2, "list of\n31 skills￿")]
    df = spark.createDataFrame(pages, "doc int, page int, text string")
    got = {(r.doc, r.stated): (r.page, r.context) for r in discovery.stated_contexts(df, "doc").collect()}
    assert got == {(1, 167): (1, "Mapped all 167 occupations. é 12 oihd 12 OIHD"), (1, 12): (1, "Mapped all 167 occupations. é 12 oihd 12 OIHD"), (2, 31): (2, "list of 31 skills￿")}
    alone = {r.stated: r.context for r in discovery.stated_contexts(df.where("page = 2 and doc = 1"), "doc").collect()}
    assert alone == {12: "x" * 39 + " total 12 items and more of it, more than forty charact"}
    m = spark.createDataFrame([("aXbXX",), ("",), (None,)], "t string").select(discovery.matches(F.col("t"), "X")).collect()
    assert [[(x.start, x.match) for x in r[0]] for r in m] == [[(1, "X"), (3, "X"), (4, "X")], [], []]


TABLE = "doc int, page_start long, page_end long, table_index int, caption string, section_title string, role string, unit string, column_count int, row_count long, layout boolean"


def test_tables_join_by_any_of_three_signs(spark):
    rows = [
        (1, 1, 1, 0, "Table 1", None, "evidence", "u", 3, 10, False), (1, 2, 2, 0, "", "S", "survey", "v", 3, 5, False),  # as many columns
        (1, 2, 2, 1, "", None, "survey", "v", 1, 1, False),  # one role on the same page
        (1, 3, 3, 0, "table 9", None, "unknown", "v", 1, 1, False),  # one column is no sign
        (1, 4, 6, 0, "TABLE 9", None, "evidence", "v", 2, 2, False), (1, 7, 7, 0, "Table 4: x", None, "other", "v", 5, 4, False),  # captions
        (1, 9, 9, 0, "Table 4: x", None, "other", "v", 5, 4, False),  # a page between
        (1, 8, 8, 0, "Table 4: x", None, "other", "v", 5, 99, True), (1, 8, 8, 1, "Table 4: x", None, "metadata", "v", 5, 99, False),
        (2, 1, 1, 0, None, None, None, None, None, 7, False), (2, 1, 1, 1, None, None, None, None, None, 8, False), (2, 3000, 3000, 0, "c", None, "r", None, 2, 1, False), (2, 3001, 3001, 0, "d", None, "r", None, 3, 1, False),
    ]
    got = [tuple(r) for r in discovery.table_groups(spark.createDataFrame(rows, TABLE)).orderBy("doc", "group_no").select("doc", "group_no", "caption", "section_title", "page_start", "page_end", "n_tables", "row_count").collect()]
    none = "Unassigned Section"
    assert got == [
        (1, 1, "Table 1", none, 1, 2, 3, 16), (1, 2, "table 9", none, 3, 7, 3, 7), (1, 3, "Table 4: x", none, 9, 9, 1, 4),
        (2, 1, "Table from Page 1", none, 1, 1, 2, 15), (2, 2, "c", none, 3000, 3001, 2, 2)]
    assert discovery.table_groups(spark.createDataFrame([], TABLE)).collect() == []


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_previous_rows_over_blocks(spark, size):
    df = spark.createDataFrame([(i % 3, i, f"v{i}") for i in range(0, 120, 2)], "k int, i int, v string")
    got = {(r.k, r.i): r.previous and r.previous.v for r in structure.with_previous(df, ["k"], "i", ["v"], F.floor(F.col("i") / size)).collect()}
    want, last = {}, {}
    for i in range(0, 120, 2):
        want[i % 3, i] = last.get(i % 3)
        last[i % 3] = f"v{i}"
    assert got == want


def test_generic_columns_by_their_names(spark):
    rows = [("a", "column_1"), ("a", "column_2"), ("b", "column_1"), ("b", "x"), ("b", "y"), ("c", "x"), ("d", None), ("e", "column_9"), ("e", "column_9")]
    got = {r.dataset_id: r.generic_columns for r in quality.generic_columns(spark.createDataFrame(rows, "dataset_id string, name string")).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False, "e": True}
    assert "oihd in mpumalanga" in K.FINAL_WORDS
