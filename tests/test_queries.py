"""Every query runs; those with SQL give the rows that DuckDB gives."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.plans.QUERIES]


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return ""
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return "" if math.isnan(v) else str(int(v)) if v.is_integer() else repr(round(v, 6) + 0.0)  # a column with nulls may come as floats
    return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else str(v)


def table(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(cell, r)) for r in frame[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    if sql := entry.oracle_sql().get(name):
        assert table(got) == table(duck.sql(sql).df())
    else:
        assert len(got.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
