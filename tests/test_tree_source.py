"""The tree as a data source: batches and streams give the same rows, underscored names included, across restarts."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom.sources import tree_source
from graphloom.sources.ignore import ignored, is_ignored
from graphloom.sources.scan import scan
from graphloom.streaming.resync import stream_parsed

FILES = ["__init__.py", "a.py", "pkg/__init__.py", "pkg/_hidden.py", "pkg/deep/er/__main__.py", "pkg/deep/x.JAVA", "pkg/note.txt", "gone/y.py", "pkg/deep/gone/z.py", ".dot/w.py"]
OLD = 1_700_000_000


def put(root, name, text, at):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (at, at))


@pytest.fixture()
def root(tmp_path):
    for i, name in enumerate(FILES):
        put(tmp_path / "src", name, f"x{i} = f{i}()\n" * (i + 1), OLD + i)
    return tmp_path / "src"


def test_a_batch_equals_the_scan(spark, root, monkeypatch):
    monkeypatch.setattr(tree_source, "BATCH_FILES", 2)
    tree_source.register(spark)
    how = tree_source.options(str(root), [".py", ".java"], "p:", ["gone"])
    got = spark.read.format("tree").options(**how).load()
    want = scan(spark, str(root), "p:", [".py", ".java"], ["gone"])
    assert sorted(tuple(r) for r in got.select("key", "rel_path", "content").collect()) == sorted(tuple(r) for r in want.select("key", "rel_path", "content").collect())
    assert got.count() == 7 and got.rdd.getNumPartitions() >= 4
    assert spark.read.format("tree").options(**tree_source.options(str(root))).load().count() == len(FILES)


def test_a_stream_gives_each_state_once_across_restarts(spark, root, tmp_path):
    seen: list = []

    def run():
        del seen[:]
        query = stream_parsed(spark, str(root), [".py"], lambda df, n: seen.extend(sorted(r["rel_path"] for r in df.collect())), str(tmp_path / "ck"), patterns=["gone"])
        assert query.awaitTermination(120)
        return seen

    every = ["__init__.py", ".dot/w.py", "a.py", "pkg/__init__.py", "pkg/_hidden.py", "pkg/deep/er/__main__.py"]
    assert sorted(run()) == sorted(every)
    assert run() == []
    put(root, "pkg/_hidden.py", "y = 1\n", OLD + 100)
    put(root, "new/__init__.py", "z = 1\n", OLD + 101)
    assert run() == ["new/__init__.py", "pkg/_hidden.py"]
    assert run() == []


def test_young_files_wait(root):
    tree = tree_source.Tree({"path": str(root)})
    put(root, "young.py", "", OLD + 10_000)
    assert tree.latest((OLD + 5_000) * 10**9) == (OLD + 9) * 10**9 and tree.latest((OLD + 20_000) * 10**9) == (OLD + 10_000) * 10**9
    assert tree.latest(0) == -1


def test_patterns_of_paths_and_of_columns_agree(spark):
    patterns = ["target/", "**/__pycache__/**", "*.pyc", "*.py", "gen", "src/*.py", "a/?.py", "*.{js,ts}", "[ab].java", "[!ab].go", "x/**"]
    paths = ["target", "target/x", "a/target/x", "a/__pycache__/b/c", "pkg/m.pyc", "src:pkg/a.py", "src/gen/q.txt", "src/a.py", "src/a/b.txt", "a/b.py", "u.ts", "a.java", "c.go", "x", "x/y/z", "plain.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    for pattern in patterns:
        got = {r["path"]: r["hit"] for r in df.select("path", ignored(F.col("path"), [pattern]).alias("hit")).collect()}
        assert got == {p: is_ignored(p, [pattern]) for p in paths}, pattern
