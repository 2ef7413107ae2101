"""Each query beside its SQL in another engine, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from graphloom.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def text(df, cols):
    out = []
    for row in df[cols].astype(object).where(df[cols].notna(), None).values.tolist():
        # columns with nulls come as floats from one side
        out.append(str([round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in row]))
    return sorted(out)


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    assert text(got, cols) == text(want, cols)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
