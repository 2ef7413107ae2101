"""A sync of what has changed gives the tables that a sync of everything gives, and reads nothing else."""

import os
import random

from graphloom import service
from graphloom.api import App
from graphloom.schemas import SEARCH, STORED, TABLES

NAMES = ["load", "save", "run", "find", "make"]


def python_file(rng, k, n):
    """A module with classes, calls by variables, imports and names that other modules have too."""
    other, third = rng.randrange(n), rng.randrange(n)
    a, b, c = (rng.choice(NAMES) for _ in range(3))
    return (
        f"import pkg.m{other}\nfrom pkg.m{third} import C{third} as Alias, helper{third}\nfrom .m{other} import C{other}\nshared{k % 3} = C{other}()\n\n"
        f"class C{k}(C{other}):\n    def {a}(self, x: C{third}):\n        x.{b}()\n        shared{rng.randrange(3)}.{c}()\n        self.{a}()\n\n"
        f"class D{k % 4}(Alias):\n    def {b}(self):\n        y = Alias()\n        y.{c}()\n        helper{third}()\n        only{rng.randrange(2 * n)}()\n\n"
        f"def helper{k}():\n    {a}()\n    Alias.{b}()\n\ndef only{k + rng.choice([0, n])}():\n    pass\n"
    )


def java_file(rng, k, n):
    other, a, b = rng.randrange(n), rng.choice(NAMES), rng.choice(NAMES)
    return f"package org.j;\nimport org.j.J{other};\nimport org.k.J{rng.randrange(n)};\npublic class J{k} extends J{other} implements Runnable {{\n  J{other} f = new J{other}();\n  void {a}() {{ f.{b}(); {b}(); J{other} v = null; v.{a}(); }}\n}}\n"


def write(root, rng, k, n):
    for path, text in ((f"pkg/m{k}.py", python_file(rng, k, n)), (f"java/J{k}.java", java_file(rng, k, n))):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


def rows(index, name):
    return sorted(map(str, (tuple(r) for r in getattr(index, name).collect())))


def test_random_edits_equal_a_full_sync(spark, tmp_path):
    rng, n, root = random.Random(1), 9, tmp_path / "src"
    for k in range(n):
        write(root, rng, k, n)
    (root / "pkg" / "__init__.py").write_text("")
    app, plain = App(spark, str(tmp_path / "home")), App(spark, str(tmp_path / "other"))
    app.registry.add("s", str(root))
    plain.registry.add("s", str(root))
    app.sync("s")
    for _ in range(2):
        for k in rng.sample(range(n), 2):
            write(root, rng, k, n)
        gone = rng.choice([f"pkg/m{k}.py" for k in range(n) if (root / f"pkg/m{k}.py").exists()])
        (root / gone).unlink()
        (root / f"java/J{rng.randrange(n)}.java").write_text("class Broken {")
        (root / f"pkg/x{rng.randrange(99)}.py").write_text(python_file(rng, rng.randrange(n), n))
        os.utime(root / "pkg" / "__init__.py")
        app.sync("s")
    plain.sync("s")
    merged, whole = (service.open_index(spark, a.registry, "s") for a in (app, plain))
    for name in [*TABLES, *SEARCH, *STORED]:
        assert rows(merged, name) == rows(whole, name), name
    assert merged.edges_calls.where("confidence > 0").count() > 10 and merged.edges_inherits.where("parent_id is not null").count() > 3


def test_only_touched_files_are_read(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    for name in ("a", "b", "c"):
        (root / f"{name}.py").write_text(f"def {name}1():\n    c1()\n")
    app = App(spark, str(tmp_path / "home"))
    app.add_service(str(root), "s")
    app.sync("s")
    assert len(service.history(app.registry, "s")) == 1  # nothing has changed, so there is nothing new
    # a file that looks the same is taken as the same, so it can't have been read
    seen = os.stat(root / "a.py")
    (root / "a.py").write_text("def z1():\n    c1()\n")
    os.utime(root / "a.py", ns=(seen.st_atime_ns, seen.st_mtime_ns))
    (root / "c.py").write_text("def moved():\n    pass\n")
    assert app.sync("s")["calls_resolved"] == 0
    assert {r["name"] for r in app._index("s").nodes.collect()} == {"<module>", "a1", "b1", "moved"}
    app.sync("s", full=True)
    assert {r["name"] for r in app._index("s").nodes.collect()} == {"<module>", "z1", "b1", "moved"}


def test_files_that_break_the_parser_are_dropped_alone(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "deep.py").write_text("x = " + "-" * 200_000 + "f()\n")
    (root / "chain.py").write_text("def f():\n    a" + ".b()" * 2_000 + "\n")
    (root / "Deep.java").write_text("class Deep { int x = " + "(" * 50_000 + "1" + ")" * 50_000 + "; }")
    (root / "good.py").write_text("def g():\n    f()\n")
    app = App(spark, str(tmp_path / "home"))
    app.add_service(str(root), "s")
    index = app._index("s")
    assert {"good.py", "chain.py"} <= {r["rel_path"] for r in index.files.collect()} and "deep.py" not in {r["rel_path"] for r in index.files.collect()}
    assert index.edges_calls.where("callee_name = 'b'").count() == 2_000 and index.edges_calls.where("callee_name = 'f' and confidence = 40").count() == 1
