"""Records of unknown fields against a plain restatement."""

import json

from siltworks.operators import normalise as N
from siltworks.plans import grids
from pyspark.sql import functions as F


def test_values_of_any_field(spark):
    raw = {
        "saqa_id": "00942", "postal_code": "12", "amount": "0042", "minus": "-0", "share": "00.50", "forms": "１２", "sure": " Y ", "never": "False", "province": "kzn", "home_region": "Limpopo",
        "city": "gp", "gap": " n/a ", "blank": "", "missing": None, "text": "ﬂat​ — “x”\r\n y", "big": "123456789012345678901234567890", "huge": "a" * 100_000,
    }
    df = spark.createDataFrame([(1, raw), (2, {}), (3, None)], "id int, record map<string,string>")
    rows = {r.id: r.v for r in df.select("id", N.normalised(F.col("record")).alias("v")).collect()}
    got = {k: (v.value, v.kind, v.changed, v.raw) for k, v in rows[1].items()}
    want = {
        # codes keep their zeros and are no numbers
        "saqa_id": ("00942", "string", False), "postal_code": ("12", "string", False), "amount": ("42", "integer", False), "minus": ("0", "integer", False), "share": ("00.50", "float", False),
        "forms": ("12", "integer", True), "sure": ("true", "boolean", True), "never": ("false", "boolean", False), "province": ("KwaZulu-Natal", "string", True), "home_region": ("Limpopo", "string", False),
        "city": ("gp", "string", False), "gap": (None, "null", True), "blank": (None, "null", False), "missing": (None, "null", False), "text": ('flat - "x" y', "string", True),
        "big": ("123456789012345678901234567890", "integer", False), "huge": ("a" * 100_000, "string", False),
    }
    assert got == {k: (*v, raw[k]) for k, v in want.items()}
    assert rows[2] == {} and rows[3] is None


def test_json_and_variant_round_trip(spark):
    texts = ['{"ofo_code": "007", "n": 12, "deep": {"a": [1, 2]}, "q\\"k": "say \\"hi\\" \\\\", "ok": true, "f": "-00.5", "none": null}', "no json", "", "[1]", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    record = df.select("id", N.normalised(N.parsed(F.col("t"))).alias("r"))
    out = {r.id: r for r in record.select("id", N.as_json(F.col("r")).alias("j"), F.try_variant_get(N.as_variant(F.col("r")), "$.n", "int").alias("n"), F.try_variant_get(N.as_variant(F.col("r")), "$.ofo_code", "string").alias("c")).collect()}
    assert json.loads(out[0].j) == {"ofo_code": "007", "n": 12, "deep": '{"a":[1,2]}', 'q"k': 'say "hi" \\', "ok": True, "f": -0.5, "none": None}
    assert (out[0].n, out[0].c) == (12, "007")
    assert all(out[i].j in (None, "{}") for i in range(1, 5))


def test_records_are_worked_out_once(spark):
    for name in ("record_normalise", "record_variant"):
        plan = getattr(grids, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert sum("ArrowEvalPython" in line for line in plan.splitlines()) == 1
        # no filter holds the work on values
        assert not [line for line in plan.splitlines() if "Filter" in line and "map_from_arrays" in line]
