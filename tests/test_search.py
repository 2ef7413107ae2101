"""BM25 against SQLite's own full-text index."""

import sqlite3

import pytest

from graphloom.operators import search
from graphloom.plans.demo_views import index_views
from graphloom.schemas import IndexTables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return index_views(spark, SF).search_docs.persist()


@pytest.fixture(scope="module")
def fts(docs):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table idx using fts5(doc_id unindexed, doc_kind unindexed, name, fqn, path, tokenize='unicode61')")
    con.executemany("insert into idx values (?, ?, ?, ?, ?)", [tuple(r) for r in docs.select("doc_id", "doc_kind", "name", "fqn", "path").collect()])
    return con


@pytest.mark.parametrize("terms", [["the"], ["the", "and"], ["src3", "en"], ["schen", "der"], ["th*", "src1"], ["nowhereword"]])
def test_scores_equal_fts5(docs, fts, terms):
    want = dict(fts.execute("select doc_id, bm25(idx, 10.0, 8.0, 4.0) from idx where idx match ?", (" ".join(terms),)).fetchall())
    got = {r["doc_id"]: r["score"] for r in search.bm25(docs, terms).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_kind_filter_comes_after_the_cut(docs):
    scored = search.bm25(docs, ["the"])
    everything = sorted((r["score"], r["doc_id"], r["doc_kind"]) for r in scored.collect())
    got = [(r["score"], r["doc_id"], r["doc_kind"]) for r in search.top_hits(scored, 3, "file").collect()]
    assert got == [r for r in everything[:12] if r[2] == "file"][:3]
    first = [(r["score"], r["doc_id"], r["doc_kind"]) for r in search.top_hits(scored, 3, "file", filter_first=True).collect()]
    assert first == [r for r in everything if r[2] == "file"][:3]
    assert search.top_hits(scored, 0).count() == 10


def test_query_terms(spark):
    assert search.query_terms(spark, "getUserNames the wax*") == ["user", "name", "wax*"]
    assert search.query_terms(spark, "<module>") == ["module"]


def test_search_enriches_and_takes_any_text(spark):
    index = _small(spark)
    rows = [r.asDict() for r in search.search(index, "Hive keepers (smoke)").collect()]
    assert [r["id"] for r in rows] == ["m2"]
    assert rows[0]["file"] == "bees/yard.py" and rows[0]["k"] == "method" and rows[0]["l"] == 3
    assert search.search(index, "hive", "file").count() == 0
    assert [r["id"] for r in search.search(index, "hiv*", "object").collect()] == ["o1"]
    assert search.search(index, "the of \"'*(").count() == 0


def _small(spark):
    from graphloom.plans.resolve import search_docs
    from graphloom.schemas import EDGES_CALLS, EDGES_IMPORTS, EDGES_INHERITS, FILES, NODES

    files = spark.createDataFrame([("f:a", 1, "a", "bees/yard.py", "python", "", "")], FILES)
    nodes = spark.createDataFrame([
        ("n:1", 1, "f:a", "object", "class", "HiveKeeper", "bees.yard.HiveKeeper", None, "global", "", "", 1, 9),
        ("n:2", 2, "f:a", "method", "method", "smoke", "bees.yard.HiveKeeper.smoke", "n:1", "member", "", "", 3, 4),
    ], NODES)
    none = lambda schema: spark.createDataFrame([], schema)
    return IndexTables(files, nodes, none(EDGES_CALLS), none(EDGES_INHERITS), none(EDGES_IMPORTS), search_docs(files, nodes))


def test_delete_file_cascades(spark):
    index = _small(spark)
    left = index.delete_file("f:a")
    assert left.files.count() == left.nodes.count() == left.search_docs.count() == 0
