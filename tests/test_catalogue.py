"""Every registered query against DuckDB on the smallest test tables."""

import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

from millrace import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{f}')")
    return c


def rows(df: pd.DataFrame, columns: list) -> Counter:
    return Counter(tuple(None if pd.isna(v) else v for v in r) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_same_rows_as_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, FOLDER).toPandas()
    want = duck.execute(catalogue.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", ["sort_one", "sort_two", "sort_length_first", "q1_like"])
def test_same_order_as_sql(spark, duck, name):
    want = duck.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert [tuple(r) for r in catalogue.queries()[name](spark, FOLDER).select(*columns).collect()] == want.fetchall()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
