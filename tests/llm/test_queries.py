import duckdb
import pytest

from graphloom.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = con.sql(oracle_sql()[name]).df(), queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    text = lambda df: sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))
    assert sorted(got.columns) == cols and text(got) == text(want)


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries()] == [f"op{i}" for i in range(1, 14)]
