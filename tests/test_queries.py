"""Every registered query against its SQL over the smallest dataset."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def canon(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        v = float(v)
        return str(v) if math.isnan(v) or math.isinf(v) else f"{v:.7g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canon, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(name, spark, data, duck):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    found = duck.sql(SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = sorted("|".join(canon(r[i]) for i in at) for r in found.fetchall())
    assert sorted("|".join(canon(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, data):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).columns
