"""What a snapshot keeps for lookups and search: the same answers as from the tables, from a few rows."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import lookups, search, walks, whole
from graphloom.plans import stored
from graphloom.schemas import TABLES, IndexTables
from graphloom.service import write_index


def made(spark, n_files, seed=1):
    """An index of n_files files with 20 methods each, calls between them at random."""
    rng = random.Random(seed)
    files = [(f"f:d/{i:06d}.py", i + 1, f"d/{i:06d}.py", f"d/{i:06d}.py", "python", "", "") for i in range(n_files)]
    nodes, calls, docs = [], [], [(f[0], "file", "", "", f"d {i:06d} py") for i, f in enumerate(files)]
    words = [f"word{k}" for k in range(40)]
    for i in range(n_files):
        for j in range(20):
            no, name = i * 20 + j + 1, f"m{j}"
            owner = f"n:python:m:x{i}.m0" if j and j % 5 == 0 else None
            nodes.append((f"n:python:m:x{i}.{name}", no, files[i][0], "method", "fn", name, f"x{i}.{name}", owner, "global", "", "", j * 3 + 1, j * 3 + 2))
            own = rng.choices(words, weights=[1 / (k + 1) for k in range(40)], k=rng.randint(1, 12))
            docs.append((nodes[-1][0], "node", own[0], " ".join(own), f"d {i:06d} py" + (" rare" if i % 97 == 0 and j == 3 else "")))
    for i in range(n_files * 40):
        calls.append((rng.choice(nodes)[0], rng.choice(nodes)[0] if i % 3 else None, "m1", "", i % 50, 40 if i % 3 else 0))
    frame = lambda rows, name: spark.createDataFrame(rows, TABLES[name])
    return IndexTables(
        files=frame(files, "files"), nodes=frame(nodes, "nodes"), edges_calls=frame(calls, "edges_calls"), edges_inherits=frame([(nodes[0][0], nodes[1][0], "x", "extends")], "edges_inherits"),
        edges_imports=frame([(files[0][0], files[-1][0], "d"), (files[0][0], None, "os")], "edges_imports"), search_docs=frame(docs, "search_docs"),
    )


@pytest.fixture(scope="module")
def small_groups():
    old = stored.ROW_GROUP, stored.PAGE_ROWS
    stored.ROW_GROUP, stored.PAGE_ROWS = 64 << 10, 200
    yield
    stored.ROW_GROUP, stored.PAGE_ROWS = old


@pytest.fixture(scope="module")
def indexes(spark, tmp_path_factory, small_groups):
    """{number of files: (tables, snapshot)}"""
    out = {}
    for n in (60, 600):
        index, path = made(spark, n), str(tmp_path_factory.mktemp("snap"))
        write_index(index, path)
        out[n] = (IndexTables.read(spark, f"file://{path}", stored=False), IndexTables.read(spark, f"file://{path}"))
    return out


def scanned(df):
    """Rows that the scans of the plan gave, counted by their metrics."""
    df.collect()
    plan, total, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan)
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan"):
            total += node.metrics().apply("numOutputRows").value()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return total


def test_lookups_read_as_little_of_a_large_tree_as_of_a_small_one(indexes):
    read = {}
    for n, (_, snap) in indexes.items():
        node = "n:python:m:x50.m0"
        asked = {
            "calls_in": snap.adjacency.where((F.col("edge") == "calls") & (F.col("dir") == "in") & (F.col("node") == node)),
            "defines_out": snap.adjacency.where((F.col("edge") == "defines") & (F.col("dir") == "out") & (F.col("node") == node)),
            "short_id": lookups.find_id(snap, "m700"), "counts": snap.node_counts.where(F.col("node_id") == node),
            "file": snap.file_counts.where(F.col("file_id") == "f:d/000050.py"), "members": lookups.file_top_methods(snap).where(F.col("file_id") == "f:d/000050.py"),
            "node": snap.nodes.where(F.col("node_id") == node), "path": lookups.get_file(snap, "d/000050.py"),
        }
        read[n] = {name: scanned(df) for name, df in asked.items()}
        assert all(df.count() for df in asked.values())
    assert all(1 <= rows <= 1_000 for rows in read[600].values()), read  # of 600 files, 12,000 nodes, 72,000 edge ends
    assert all(read[600][k] <= 3 * read[60][k] + 200 for k in read[600]), read


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_the_snapshot_answers_as_the_tables_do(indexes):
    plain, snap = indexes[60]
    for e in walks.EDGES:
        for d in ("out", "in"):
            same(walks.walk_rows(plain, e, d), walks.walk_rows(snap, e, d))
    for f in (lookups.object_counts, lookups.method_counts, lookups.file_objects, lookups.file_top_methods, lookups.stats, whole.tree):
        same(f(plain), f(snap))
    for short in ("m1", "m1200", "f60", "o1", "f61"):
        same(lookups.find_id(plain, short), lookups.find_id(snap, short))
    page, total = walks.walk(snap, "n:python:m:x5.m1", "calls", "both", 2, -5)
    assert total == walks.walk(plain, "n:python:m:x5.m1", "calls")[1] and page.count() <= 4
    with pytest.raises(ValueError, match="direction"):
        walks.walk_rows(snap, "calls", "up")


QUERIES = [["word0"], ["word0", "word1"], ["word3", "word7"], ["rare"], ["rare", "word0"], ["word1*"], ["wor*", "000050"], ["none"], ["none*", "word0"], ["d", "py", "word2"]]


@pytest.mark.parametrize("k", [1, 8, 40])
def test_blocks_find_the_same_best(indexes, monkeypatch, k):
    plain, snap = indexes[600]
    monkeypatch.setattr(search.BlockSearch, "FIRST", 2)
    for named in (4_096, 0):
        monkeypatch.setattr(search.BlockSearch, "NAMED", named)
        for terms in QUERIES if named and k == 8 else QUERIES[:2]:
            want = search.top_hits(search.bm25(plain.search_docs, terms), k).collect()
            got = search.top_hits(search.BlockSearch(snap, terms, k).scored(), k).collect()
            assert [r["doc_id"] for r in got] == [r["doc_id"] for r in want], terms
            assert [r["score"] for r in got] == pytest.approx([r["score"] for r in want], rel=1e-9)


def test_few_blocks_are_scored_and_no_documents_scanned(indexes, monkeypatch):
    _, snap = indexes[600]
    monkeypatch.setattr(search.BlockSearch, "FIRST", 2)
    blocks = snap.posting_blocks.select("block").distinct().count()
    assert blocks >= 12
    one = search.BlockSearch(snap, ["rare", "word0"], 3)
    plan = one.scored()._jdf.queryExecution().toString()
    assert one.blocks_scored <= 8 and "doc_stats" not in plan and "search_docs" not in plan
    assert scanned(one.scored()) < snap.postings.count() / 10
