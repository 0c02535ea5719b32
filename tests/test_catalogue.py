"""Every catalogue query against its SQL in DuckDB at the smallest scale."""

import math
import os

import duckdb
import pytest

from loreline.plans import catalogue

SF = "/root/testdata/sf0.001"


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    rows = df.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    got = duck.execute(sql)
    cols = [c[0] for c in got.description]
    want = sorted((tuple(norm(v) for v in r) for r in got.fetchall()), key=str)
    assert sorted(cols) == sorted(df.columns)
    assert sorted((tuple(norm(r[c]) for c in cols) for r in rows), key=str) == want
