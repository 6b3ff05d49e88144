"""Every registered query against its SQL twin in DuckDB."""

import math

import duckdb
import pytest

from siltworks.plans import grids as slate

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def canon(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) and math.isfinite(v) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(slate.QUERIES))
def test_query(spark, duck, name):
    df = slate.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = canon(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert len(got) > 0
    if name in slate.ORACLES:
        cur = duck.execute(slate.ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == columns
        want = canon(tuple(r[names.index(c)] for c in columns) for r in cur.fetchall())
        assert len(got) == len(want)
        assert got == want
