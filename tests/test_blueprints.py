"""Built-in schemas: lookup, reading and rules."""

from siltworks.functions import constants as K
from siltworks.operators import blueprints, validation
from pyspark.sql import functions as F


def test_lookup_falls_back(spark):
    df = spark.createDataFrame([("Financial",), ("occupations",), ("nothing",), (None,), ("",)], "n string")
    assert [r[0] for r in df.select(blueprints.chosen(F.col("n"))).collect()] == ["financial", "occupations"] + ["universal_auto"] * 3
    rows = blueprints.fields(spark).collect()
    assert len(rows) == sum(len(v[3]) for v in K.BLUEPRINTS.values()) and {r.field for r in rows if r.primary_key} == {"saqa_id", "ofo_code", "variable_name", "account_code"}


def test_grids_are_read_and_checked(spark):
    grid = [(1, 0, ["Total", "Account", "Particulars", "FY"]), (1, 1, ["R 1,200.50", "A1", "Sales", "2020"]), (1, 2, ["about ten", "A2", "", None]), (2, 0, ["A3", "Rent", "-12", "2021"])]
    rows = spark.createDataFrame(grid, "table_id long, row_index long, cells array<string>")
    read = blueprints.read(rows, "financial")
    got = {(r.table_id, r.row_index): (r.account_code, r.line_item, r.amount, r.period) for r in read.collect()}
    assert got == {(1, 1): ("A1", "Sales", "R 1,200.50", "2020"), (1, 2): ("A2", "", "about ten", ""), (2, 0): ("A3", "Rent", "-12", "2021")}
    keyed = read.select((F.col("table_id") * 10 + F.col("row_index")).alias("id"), "line_item", "amount")
    found = sorted((r.id, r.column, r.rule) for r in validation.issues_by_rules(keyed, "id", blueprints.rules(spark, "financial")).collect())
    assert found == [(12, "amount", "currency"), (12, "line_item", "required")]
    assert blueprints.rules(spark, "universal_auto").collect() == [] and blueprints.read(rows, "universal_auto").count() == 4
