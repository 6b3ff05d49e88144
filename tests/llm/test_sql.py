"""The corpus queries with SQL against DuckDB on whole tables."""

import duckdb
import pytest

from siltworks.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        duck.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    cur = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in cur.description]
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(cur.fetchall())


def test_many_shards_a_task(spark, monkeypatch):
    from siltworks.llm import shards

    name = "op1_substring_dedup"
    want = {tuple(r) for r in registry.QUERIES[name](spark, SF).collect()}
    monkeypatch.setattr(shards, "SHARD_BYTES", 4096)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert shards.shards_for(docs.withColumnRenamed("text", "__text")) > 64
    assert {tuple(r) for r in registry.QUERIES[name](spark, SF).collect()} == want
