"""Every registered query of the inventory against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from quillon.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def canon(v):
    if v is None or isinstance(v, (bool, int, str)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(canon, v))
    return "nan" if math.isnan(v) else float(f"{float(v):.9g}")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    left = [tuple(canon(r[c]) for c in order) for r in df.collect()]
    right = [tuple(canon(r[want.columns.index(c)]) for c in order) for r in want.fetchall()]
    assert sorted(left, key=repr) == sorted(right, key=repr)
