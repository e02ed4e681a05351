"""Every registered query of the operators against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from graintable.plans import registry

DATA = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def norm(v):
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    got = duck.execute(SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted((tuple(norm(r[columns.index(c)]) for c in order) for r in got.fetchall()), key=repr)
    have = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=repr)
    assert have == want
