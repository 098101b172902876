"""Every query that SQL can express, against DuckDB on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows_of(df):
    columns = sorted(df.columns)
    return columns, Counter(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).astype(str).values))


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, data, name):
    found, wanted = rows_of(QUERIES[name](spark, data).toPandas()), rows_of(duck.sql(SQL[name]).df())
    assert found[0] == wanted[0]
    assert found[1] == wanted[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    """Queries that SQL can't express give rows, without repeats, and no column of unknown type; what is in them is tested with their operators."""
    df = QUERIES[name](spark, data)
    rows = df.count()
    assert 0 < rows == df.distinct().count()
    assert all(kind != "void" for _, kind in df.dtypes)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
