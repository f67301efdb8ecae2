"""Every query with SQL against DuckDB over the smallest tables, and every query's columns."""

import math
import numbers
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from sangam.plans import fusion, problems, records

MODULES = {**fusion.QUERIES, **problems.QUERIES, **records.QUERIES}
SQL = {**fusion.SQL, **problems.SQL, **records.SQL}


def rows(df):
    def one(x):
        if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(float(x), 5) if isinstance(x, numbers.Real) and not isinstance(x, bool) else str(x)

    cols = sorted(df.columns)
    return cols, sorted((tuple(one(x) for x in r) for r in df[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, duck, name):
    assert rows(entry.queries()[name](spark, sf).toPandas()) == rows(duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(MODULES) - set(SQL)))
def test_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).toPandas() is not None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
