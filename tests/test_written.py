"""What writing a snapshot leaves on the disks and moves between tasks."""

import os
import time

import pytest
from pyspark.sql import functions as F

from graphloom import source_queries
from graphloom.functions import analyzer
from graphloom.plans import demo_views, stored
from graphloom.queries import QUERIES
from graphloom.schemas import IndexTables
from graphloom.service import write_index

SF = "/root/testdata/sf0.001"


def shuffles_left(spark):
    """The shuffles with files on this process's disks, once Spark has had time to delete those that are not wanted any more."""
    for _ in range(50):
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = [files.apply(i).getName() for i in range(files.size())]
        if not (found := {n.split("_")[1] for n in names if n.startswith("shuffle_")}):
            break
        time.sleep(0.1)
    return found


@pytest.mark.parametrize("name", ["search_topk_stored", "walks_stored", "resolve_id_stored"])
def test_shuffle_files_of_the_tables_go_before_the_result_is_read(spark, monkeypatch, name):
    left, read = {}, IndexTables.read.__func__

    def seen(cls, session, path, *also, **how):
        if os.path.exists(f"{path}/edges_calls".removeprefix("file:")):
            left["now"] = shuffles_left(session)
        return read(cls, session, path, *also, **how)

    monkeypatch.setattr(IndexTables, "read", classmethod(seen))
    assert QUERIES[name](spark, SF).count()
    assert len(left["now"]) <= 2  # Python may let go of the last ones a moment later


def plans(spark, monkeypatch, path, also, index=None):
    """The plans of the tables that are written."""
    out, write = {}, stored.write_sorted

    def noted(df, path, name):
        out[name] = df._jdf.queryExecution().executedPlan().toString()
        write(df, path, name)

    monkeypatch.setattr(stored, "write_sorted", noted)
    write_index(demo_views.index_views(spark, SF) if index is None else index, path, also)
    return out


def test_postings_are_made_where_their_document_is(spark, monkeypatch, tmp_path):
    made = plans(spark, monkeypatch, f"{tmp_path}/i", ("search",))["postings"]
    # documents and their sizes are moved; what the words become is not
    assert made.count("Exchange") == 2 and "Exchange" not in made[: made.index("Generate")]


def test_search_documents_are_not_moved(spark, tmp_path, monkeypatch):
    write_index(demo_views.index_views(spark, SF), f"{tmp_path}/i", ())
    assert "search_docs" not in stored.KEYS
    want = demo_views.index_views(spark, SF).search_docs
    got = spark.read.parquet(f"file://{tmp_path}/i/search_docs")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_ranges_have_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "RANGE_ROWS", 300)
    write_index(demo_views.index_views(spark, SF), f"{tmp_path}/i", ())
    calls = spark.read.parquet(f"file://{tmp_path}/i/edges_calls").groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"), F.min("caller_id").alias("a"), F.max("caller_id").alias("b"))
    rows = sorted((r["a"], r["b"], r["n"]) for r in calls.collect())
    assert sum(r[2] for r in rows) > 5_000 and max(r[2] for r in rows) < 1_200
    assert all(x[1] < y[0] for x, y in zip(rows, rows[1:]))


def test_a_table_that_is_shown_whole_is_not_copied(spark):
    rows = QUERIES["walks_stored"](spark, SF)
    read = {os.path.dirname(f) for f in rows.inputFiles()}
    assert len(read) == 1 and next(iter(read)).endswith("/adjacency")
    assert [n for n in os.listdir(os.path.dirname(next(iter(read))).removeprefix("file://").removeprefix("file:"))] == ["adjacency"]
    assert rows.count() == source_queries.stored(spark, [demo_views.index_views(spark, SF)], lambda i: i.adjacency, ("lookups",)).count()


def test_terms_are_counted_without_folding_them(spark):
    letters = "".join(chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000)
    texts = [f"a{x}b {x}" for x in letters] + ["İstanbul ÀÉ", "", "x--y  z", "straße ǅ ŉ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.where(F.size(analyzer.index_terms(F.col("t"))) != analyzer.n_index_terms(F.col("t"))).collect() == []
