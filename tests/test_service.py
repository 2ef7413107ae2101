"""Projects on disk, through scan, parse, resolution, snapshots and the API."""

import json
import os
import urllib.parse
from pathlib import Path

import pytest

from graphloom import files
from graphloom.api import App
from graphloom.operators import search
from graphloom.server import answer, http_answer
from graphloom.sources.ignore import ignored
from graphloom.sources.scan import list_tree
from graphloom.streaming.resync import changes, fingerprints, stream_parsed

FILES = {
    "garden/__init__.py": "",
    "garden/soil/__init__.py": "DEPTH: int = 3\n",
    "garden/soil/beds.py": "import math\n\nclass Bed:\n    def plant(self, seed, row=0):\n        water()\n        return math.floor(row)\n\ndef water():\n    pass\n",
    "garden/tools.py": "from garden.soil.beds import Bed as Plot\nfrom . import soil\n\nclass Tool:\n    pass\n\nclass SeedDrill(Tool):\n    '''Sows in rows.'''\n    def sow(self, seed):\n        plot = Plot()\n        plot.plant(seed)\n        math.sqrt(2)\n\nclass Shed:\n    class Hook(SeedDrill):\n        def hang(self):\n            self.swing()\n",
    "b/y.py": "import garden.tools\nrake = 1\n",
    "b.py": "def rake():\n    pass\n\nrake()\n",
    "broken.py": "def (:\n",
    "note.txt": "text",
    "dist/skip.py": "x = 1\n",
    "deep/dist/kept.py": "x = 1\n",
    "java/org/barn/Animal.java": "package org.barn;\npublic interface Animal { void feed(String s); }\n",
    "java/org/barn/Goat.java": "package org.barn;\nimport org.barn.Animal;\npublic class Goat implements Animal {\n  /** Feeds. */\n  public void feed(String s) { bleat(); }\n  void bleat() { Animal a = null; a.feed(\"hay\"); }\n}\n",
}


@pytest.fixture(scope="module")
def app(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("src")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    app = App(spark, str(tmp_path_factory.mktemp("home")))
    folder = Path(app.registry.dir("farm"))
    folder.mkdir(parents=True)
    (folder / "service.ignore").write_text("# build output\ndist/\n")
    app.root = root
    app.add_service(str(root), "farm", "A farm")
    return app


def edges(app):
    index = app._index("farm")
    names = index.nodes.select("node_id", "fqn")
    rows = index.edges_calls.join(names.toDF("caller_id", "caller"), "caller_id").join(names.toDF("callee_id", "callee"), "callee_id", "left")
    return {(r["caller"], r["callee_owner"], r["callee_name"]): (r["callee"], r["confidence"]) for r in rows.collect()}


def test_counts_and_order(app):
    assert app.stats("farm")["files"] == 9
    index = app._index("farm")
    assert [r["rel_path"] for r in index.files.orderBy("short_id").collect()] == [
        "b/y.py", "b.py", "deep/dist/kept.py", "garden/__init__.py", "garden/soil/__init__.py", "garden/soil/beds.py", "garden/tools.py", "java/org/barn/Animal.java", "java/org/barn/Goat.java",
    ]
    numbers = sorted(r["short_id"] for r in index.nodes.select("short_id").collect())
    assert numbers == list(range(1, len(numbers) + 1))


def test_calls(app):
    e = edges(app)
    assert e["garden.tools.SeedDrill.sow", "plot", "plant"] == ("garden.soil.beds.Bed.plant", 40)
    assert e["garden.tools.SeedDrill.sow", "math", "sqrt"] == (None, 0)
    assert e["garden.soil.beds.Bed.plant", "", "water"] == ("garden.soil.beds.water", 100)
    assert e["b.<module>", "", "rake"] == ("b.rake", 100)
    assert e["org.barn.Goat.feed", "", "bleat"] == ("org.barn.Goat.bleat", 100)
    assert e["org.barn.Goat.bleat", "a", "feed"] == ("org.barn.Animal.feed", 70)
    assert e["garden.tools.Shed.Hook.hang", "self", "swing"] == (None, 0)


def test_inherits_imports_and_owners(app):
    index = app._index("farm")
    names = {r["node_id"]: r["fqn"] for r in index.nodes.collect()}
    got = {(names[r["child_id"]], names.get(r["parent_id"]), r["relation"]) for r in index.edges_inherits.collect()}
    assert got == {("garden.tools.SeedDrill", "garden.tools.Tool", "extends"), ("garden.tools.Shed.Hook", "garden.tools.SeedDrill", "extends"), ("org.barn.Goat", "org.barn.Animal", "implements")}
    imports = {(r["file_id"], r["raw"], r["target_file_id"]) for r in index.edges_imports.collect()}
    assert imports == {
        ("f:b/y.py", "garden.tools", "f:garden/tools.py"), ("f:garden/tools.py", "garden.soil.beds", "f:garden/soil/beds.py"), ("f:garden/tools.py", "garden", "f:garden/__init__.py"),
        ("f:garden/soil/beds.py", "math", None), ("f:java/org/barn/Goat.java", "org.barn.Animal", "f:java/org/barn/Animal.java"),
    }
    owners = {names[r["node_id"]]: names[r["owner_id"]] for r in index.nodes.where("owner_id is not null").collect()}
    assert owners["garden.tools.Shed.Hook"] == "garden.tools.Shed" and owners["garden.tools.Shed.Hook.hang"] == "garden.tools.Shed.Hook"


def test_search_reads_the_stored_postings_of_its_terms(app):
    index = app._index("farm")
    plan = search.bm25(index.search_docs, ["seed", "dril*"], index.postings, index.doc_stats)._jdf.queryExecution().toString()
    assert "EqualTo(term,seed)" in plan and "StringStartsWith(term,dril)" in plan and "transform(" not in plan
    for terms in (["seed"], ["seed", "drill"], ["pla*"], ["none"]):
        stored, made = (sorted(map(tuple, search.bm25(index.search_docs, terms, *more).collect())) for more in ((index.postings, index.doc_stats), ()))
        assert [r[:2] for r in stored] == [r[:2] for r in made] and [r[2] for r in stored] == pytest.approx([r[2] for r in made])


def test_ignored_directories_are_not_looked_into(spark, tmp_path, monkeypatch):
    for name in ("a/x.py", "a/b/c/z.py", "gone/y.py", "a/gone/w.py", "a/b/empty.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    found = list_tree(spark, str(tmp_path), ["gone"])
    assert sorted(r["rel_path"] for r in found.collect()) == ["a/b/c/z.py", "a/b/empty.txt", "a/x.py"]
    assert list_tree(spark, str(tmp_path)).count() == 5
    with pytest.raises(Exception):
        list_tree(spark, str(tmp_path / "missing")).collect()


def test_places_by_uri(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "m.py").write_text("def f():\n    return g()\n")
    app = App(spark, f"file://{tmp_path}/home")
    assert app.add_service(f"file://{tmp_path}/src")["root"] == f"file://{tmp_path}/src"
    assert app.stats("src")["files"] == 1 and app.code("src", "m2")["src"] == "def f():\n    return g()"
    assert files.full("s3://b/x") == "s3://b/x" and files.for_spark("s3://b/x") == "s3://b/x"


def test_search_peek_walk_code(app):
    hit = app.search("farm", "seed drills")["hits"][0]
    assert hit["k"] == "object" and hit["name"] == "SeedDrill" and hit["file"] == "garden/tools.py"
    peek = app.peek("farm", hit["id"])
    assert peek["doc"] == "Sows in rows." and len(peek["methods"]) == 1 and len(peek["extends"]) == 1 and peek["extended_by"] == 1
    sow = app.peek("farm", peek["methods"][0])
    assert sow["calls"] == 3 and sow["unresolved_calls"] == 2 and sow["owner"] == hit["id"] and sow["sig"] == "def sow(self, seed)"
    walk = app.walk("farm", sow["id"], "calls", "out")
    assert walk["total"] == 3 and [i.get("hint") for i in walk["items"]] == ["Plot", None, "math.sqrt"]
    back = app.walk("farm", walk["items"][1]["to"], "calls", "in")
    assert back["items"] == [{"from": sow["id"], "name": "sow", "fqn": "garden.tools.SeedDrill.sow", "file": "garden/tools.py", "l": 9, "line": 11, "conf": 40}]
    assert app.walk("farm", "n:python:m:none:none:1", "calls") == {"items": None, "total": 0}
    code = app.code("farm", sow["id"], 1)
    assert (code["start"], code["end"]) == (8, 13) and code["src"].startswith("    '''Sows in rows.'''\n    def sow")
    with pytest.raises(ValueError):
        app.walk("farm", sow["id"], "friends")
    with pytest.raises(KeyError):
        app.peek("farm", "m9999")
    with pytest.raises(ValueError):
        app.code("farm", "f1")


def test_file_tree_graph(app):
    f = app.file("farm", "garden/tools.py")
    assert [i["raw"] for i in f["imports"]] == ["garden", "garden.soil.beds"] and [o["name"] for o in f["objects"]] == ["Tool", "SeedDrill", "Shed", "Hook"]
    assert [m["name"] for m in f["methods"]] == ["<module>"] and app.file("farm", f["id"]) == f
    tree = {t["path"]: t for t in app.tree("farm")["files"]}
    assert len(tree) == 9 and tree["garden/tools.py"]["objects"] == 4
    graph = app.graph("farm")
    ids = {n["id"] for n in graph["nodes"]}
    assert len(ids) == len(graph["nodes"]) and all(e["from"] in ids and e["to"] in ids for e in graph["edges"])
    assert {e["t"] for e in graph["edges"]} == {"defines", "calls", "inherits", "imports"}
    paths = [t["path"] for t in app.tree("farm")["files"]]
    assert [t["path"] for t in app.tree("farm", 3, 2)["files"]] == paths[2:5]


def test_exported_graph_is_the_graph(app, spark, tmp_path):
    graph, places = app.graph("farm"), app.export_graph("farm", str(tmp_path / "g"))
    assert {k: spark.read.parquet(v).count() for k, v in places.items()} == {k: len(v) for k, v in graph.items()}


def tool(app, name, **arguments):
    result = answer(app, {"id": 2, "method": "tools/call", "params": {"name": name, "arguments": arguments}})["result"]
    text = result["content"][0]["text"]
    return text if result.get("isError") else json.loads(text)


def test_tools_by_their_outer_names(app):
    tools = {t["name"]: t["inputSchema"] for t in answer(app, {"id": 1, "method": "tools/list"})["result"]["tools"]}
    assert len(tools) == 10 and tools["walk"]["required"] == ["serviceId", "id", "edge"] and set(tools["code"]["properties"]) == {"serviceId", "id", "ctx"}
    assert tool(app, "stats", serviceId="farm")["files"] == 9 and tool(app, "search", query="x") == "missing: serviceId"
    hit = tool(app, "search", serviceId="farm", query="sow", kind="method", limit=3)["hits"][0]
    assert tool(app, "peek", serviceId="farm", id=hit["id"])["name"] == "sow"
    assert tool(app, "walk", serviceId="farm", id=hit["id"], edge="calls", dir="out", limit=1, offset=1)["items"][0]["line"] == 11
    assert tool(app, "code", serviceId="farm", id=hit["id"], ctx=1)["start"] == 8
    assert tool(app, "file", serviceId="farm", path="b.py")["path"] == "b.py"
    assert tool(app, "update_service_meta", serviceId="farm", mainEntities='["SeedDrill"]') == {"status": "ok"}
    assert app.info("farm")["mainEntities"] == ["SeedDrill"] and "unknown id" in tool(app, "peek", serviceId="farm", id="m9999")
    assert tool(app, "sync", serviceId="farm") == {"status": "ok", "serviceId": "farm"}
    assert tool(app, "add_service", rootAbs=str(app.root / "java"), serviceId="barn", mainEntities='["Goat"]') == {"serviceId": "barn"}
    assert {s["id"] for s in tool(app, "services")} == {"barn", "farm"}
    app.registry.remove("barn")


def test_servers(app):
    assert answer(app, {"id": 3, "method": "tools/call", "params": {"name": "tree", "arguments": {"serviceId": "farm"}}})["result"]["isError"]
    assert answer(app, {"method": "notifications/initialized"}) is None and "error" in answer(app, {"id": 4, "method": "nope"})
    status, hits = http_answer(app, "/api/search?service=farm&q=" + urllib.parse.quote("seed drill"))
    assert status == 200 and hits["hits"] and http_answer(app, "/api/search?q=seed+drill", "farm") == (status, hits)
    assert http_answer(app, "/api/info?service=farm")[1]["stats"]["files"] == 9
    assert http_answer(app, "/other")[0] == 404 and http_answer(app, "/api/peek?service=farm&id=x1")[0] == 400


def test_meta_and_failed_sync_keep_the_snapshot(app):
    app.update_service_meta("farm", main_entities=["Goat"])
    assert app.services() == [{"id": "farm", "root": str(app.root), "description": "A farm", "mainEntities": ["Goat"]}]
    with pytest.raises(ValueError):
        app.registry.add("farm", "/elsewhere")
    twice = app.root / "Twice.java"
    twice.write_text("class Twice { void f() {} void f(int x) {} }\n")
    with pytest.raises(ValueError, match="two symbols"):
        app.sync("farm")
    twice.unlink()
    assert app.stats("farm")["files"] == 9


def test_reindex_replaces(app):
    path = app.root / "b.py"
    path.write_text("class Spade:\n    pass\n")
    assert app.sync("farm")["files"] == 9
    names = {r["name"] for r in app._index("farm").nodes.collect()}
    assert "Spade" in names and "rake" not in names
    path.write_text(FILES["b.py"])


def test_ignore_patterns(spark):
    cases = [
        ("target/", "target/x", True), ("target/", "a/target/x", False), ("target/", "target", False), ("**/__pycache__/**", "a/b/__pycache__/c.py", True),
        ("**/__pycache__/**", "__pycache__/c.py", True), ("*.pyc", "pkg/module.pyc", True), ("*.py", "src:pkg/a.py", False), ("gen", "src/gen/a.py", True), ("src/*.py", "src/a/b.py", False),
        ("a/?.py", "a/b.py", True), ("*.{js,ts}", "x/y.ts", True), ("[ab].py", "b.py", True), ("[!ab].py", "b.py", False),
    ]
    from pyspark.sql import functions as F

    for pattern, path, want in cases:
        assert spark.range(1).select(ignored(F.lit(path), [pattern]).alias("x")).first()["x"] == want, (pattern, path)


def test_changes_and_stream(spark, tmp_path):
    rows = lambda d: spark.createDataFrame([(k, v.encode()) for k, v in d.items()], "key string, content binary")
    old, new = fingerprints(rows({"a": "1", "b": "2", "c": "3"})), fingerprints(rows({"a": "1", "b": "x", "d": "4"}))
    assert {tuple(r) for r in changes(old, new).collect()} == {("b", "modified"), ("c", "removed"), ("d", "added")}
    src = tmp_path / "src"
    src.mkdir()
    (src / "m.py").write_text("def f(): pass\n")
    os.utime(src / "m.py", (1_700_000_000, 1_700_000_000))
    seen = []
    stream_parsed(spark, str(src), [".py"], lambda df, n: seen.extend((r["rel_path"], len(r["methods"])) for r in df.collect()), str(tmp_path / "ck")).awaitTermination(60)
    assert seen == [("m.py", 2)]
