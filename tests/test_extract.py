import random

from graphloom.sources.parse_java import parse_java
from graphloom.sources.parse_python import parse_python

PY = b'''"""Module."""
import os, a.b as c
import x.y
from .pkg import Thing as T, other
from m import *

@deco(make())
class Cat(Animal, pkg.Mixin[int], metaclass=Meta):
    """A cat.

    More."""
    def __init__(self, food: Food, *more: Bar, n: "str" = f()):
        self.food = food
        helper()
        helper()

    @property
    async def name(self) -> str:
        def inner():
            return deep()
        x = T(1)
        y: List[T] = g()
        return (self.food.get)().strip()

    class Tail:
        def wag(self): return wave(1)(2)

limit: Limit = Limit()
z = other()
if True:
    def hidden(): pass
'''


def by(rows, *keys):
    return [tuple(r[k] for k in keys) for r in rows]


def test_python_symbols():
    r = parse_python(PY)
    assert by(r["imports"], "raw", "alias") == [("os", "os"), ("a.b", "c"), ("x.y", "x"), (".pkg", "T"), (".pkg", "other"), ("m", "")]
    assert by(r["objects"], "fqn", "doc", "start_line") == [("Cat", "A cat.", 8), ("Cat.Tail", "", 25)]
    assert by(r["objects"][0]["bases"], "name") == [("Animal",), ("pkg.Mixin[int]",), ("metaclass=Meta",)]
    assert by(r["methods"], "fqn", "subkind", "scope") == [
        ("<module>", "module", "global"), ("Cat.__init__", "ctor", "member"), ("Cat.name", "method", "member"), ("Cat.Tail.wag", "method", "member"),
    ]
    assert r["methods"][1]["signature"] == 'def __init__(self, food: Food, *more: Bar, n: "str" = f())'
    assert r["methods"][2]["signature"] == "async def name(self) -> str"
    assert by(r["calls"], "caller_fqn", "callee_owner", "callee_name", "line") == [
        ("<module>", "", "deco", 7), ("<module>", "", "make", 7), ("Cat.__init__", "", "helper", 14),
        ("Cat.name.inner", "", "deep", 20), ("Cat.name", "", "T", 21), ("Cat.name", "", "g", 22), ("Cat.name", "(self.food.get)()", "strip", 23),
        ("Cat.name", "self.food", "get", 23), ("Cat.Tail.wag", "", "wave(1)", 26), ("Cat.Tail.wag", "", "wave", 26), ("<module>", "", "Limit", 28), ("<module>", "", "other", 29),
    ]
    assert ("Cat.name", "", "T") in by(r["calls"], "caller_fqn", "callee_owner", "callee_name")
    assert by(r["calls"], "callee_name").count(("helper",)) == 1
    types = by(r["var_types"], "scope_fqn", "var_name", "type_name")
    assert ("Cat.__init__", "food", "Food") in types and ("Cat.name", "x", "T") in types and ("Cat.name", "y", "List") in types
    assert ("", "limit", "Limit") in types and ("", "z", "other") in types


def test_python_lines_end_as_the_syntax_tree_counts_them():
    want = parse_python(PY)
    assert parse_python(b"\xef\xbb\xbf" + PY) == want
    for mark in (b"\x0c", "# \u2028 \x85 \x1c".encode(), b"# \x0b\x0c"):
        got = parse_python(PY.replace(b"from m import *\n", b"from m import *\n" + mark, 1).replace(b"more.\n", b"more.\n", 1))
        assert got == want, mark
    for end in (b"\r\n", b"\r"):
        got = parse_python(PY.replace(b"\n", end))
        for part in ("imports", "objects", "calls", "var_types"):
            assert got[part] == want[part]
        assert by(got["methods"][1:], "fqn", "signature", "doc", "start_line", "end_line") == by(want["methods"][1:], "fqn", "signature", "doc", "start_line", "end_line")


def test_python_files_that_fail_or_are_empty():
    assert parse_python(b"def broken(:\n") is None and parse_python(b"\xff\xfe") is None
    empty = parse_python(b"")
    assert by(empty["methods"], "name", "start_line", "end_line") == [("<module>", 1, 1)] and not empty["calls"]
    long = parse_python(('"""d"""\ndef f():\n    "' + "é" * 200 + '"\n').encode())
    assert len(long["methods"][1]["doc"].encode()) == 120


JAVA = b'''package com.x;

import java.util.*;
import static com.y.Foo.bar;
import com.z.Repo;

/** Doc of A.
 *  more */
@Ann(value = "x{")
public class A<T extends Comparable<T>> extends p.Base<T> implements I1, I2<String> {
    private final Map<String, List<Integer>> m = new HashMap<>(), n;
    private Repo repo = Repo.create();
    static { init(); }
    enum E { X(1) { void q() {} }, Y(2); private int v; E(int v) { this.v = v; } int get() { return v; } }
    interface J extends K, L { void z(int a, String... rest); }
    public A(Repo r) { this.repo = r; super.foo(); }
    /** Runs it. */
    @Override
    public <U> List<U> run(final String s, Map<String, U> mm) throws E1 {
        Repo local = new Repo(), other = null;
        for (String t : list) { local.save(t); local.save(s); }
        if (a < b) { c.d.e(); }
        foo().bar().baz(x -> inner(x));
        new Thread(new p.Runner() { public void run() { go(); } }).start();
        this.repo.save(s); // comment }
        String text = """
            not { code()
            """;
        return Collections.<U>emptyList();
    }
}
record P(int a) {}
'''


def test_java_symbols():
    r = parse_java(JAVA)
    assert r["package"] == "com.x"
    assert by(r["imports"], "raw", "alias") == [("java.util", "util"), ("com.y.Foo.bar", "bar"), ("com.z.Repo", "Repo")]
    assert by(r["objects"], "fqn", "subkind", "doc", "start_line") == [("com.x.A", "class", "Doc of A.", 9), ("com.x.A.E", "enum", "", 14), ("com.x.A.J", "interface", "", 15)]
    assert by(r["objects"][0]["bases"], "name", "relation") == [("p.Base", "extends"), ("I1", "implements"), ("I2", "implements")]
    assert by(r["objects"][2]["bases"], "name", "relation") == [("K", "extends"), ("L", "extends")]
    assert by(r["methods"], "fqn", "subkind") == [
        ("com.x.A.E.E", "ctor"), ("com.x.A.E.get", "method"), ("com.x.A.J.z", "method"), ("com.x.A.A", "ctor"), ("com.x.A.run", "method"), ("com.x.A.<init>", "init"),
    ]
    run = r["methods"][4]
    assert (run["signature"], run["doc"], run["start_line"]) == ("List<U> run(final String s, Map<String, U> mm)", "Runs it.", 18)
    assert [c for c in by(r["calls"], "caller_fqn", "callee_owner", "callee_name") if c[0] == "com.x.A.run"] == [
        ("com.x.A.run", *x) for x in [
            ("", "Repo"), ("local", "save"), ("d", "e"), ("foo().bar()", "baz"), ("foo()", "bar"), ("", "foo"), ("", "inner"),
            ("Thread", "start"), ("", "Thread"), ("p", "Runner"), ("", "go"), ("repo", "save"), ("Collections", "emptyList"),
        ]
    ]
    assert [c[1:] for c in by(r["calls"], "caller_fqn", "callee_owner", "callee_name") if c[0] == "com.x.A.<init>"] == [("", "HashMap"), ("Repo", "create"), ("", "init")]
    types = by(r["var_types"], "scope_fqn", "var_name", "type_name")
    for want in (("com.x.A", "m", "Map"), ("com.x.A", "n", "Map"), ("com.x.A", "repo", "Repo"), ("com.x.A.run", "local", "Repo"), ("com.x.A.run", "other", "Repo"), ("com.x.A.run", "mm", "Map"), ("com.x.A.E", "v", "int")):
        assert want in types


def test_java_files_that_fail():
    assert parse_java(b"class A { void f( }") is None and parse_java(b"class {") is None and parse_java(b"int x;") is None
    assert parse_java(b"")["objects"] == [] and parse_java(b"// only a comment")["methods"] == []
    overloads = parse_java(b"class A { void f() {} int f(int x) { return g(x); } }")
    assert by(overloads["methods"], "fqn") == [("A.f",), ("A.f",)]


def _receiver(rng, depth):
    """(text of an expression that a call can follow, owner of that call), by construction."""
    kind = rng.randrange(9 if depth else 4)
    inner = lambda: _receiver(rng, depth - 1)[0]
    name, kind_name = rng.choice(["a", "order", "x9", "_b", "$c"]), rng.choice(["Foo", "p.q.Bar", "Baz"])
    if kind == 0:
        return name, name
    if kind == 1:
        return rng.choice(["this", "super"]), ""
    if kind == 2:
        return '"text; } // no"', '"text; } // no"'
    if kind == 3:
        return f"this.{name}", name
    if kind == 4:
        text = f"{inner()}.field"
        return text, "field"
    if kind == 5:
        text = f"{inner()}.{rng.choice(['', '', '<T>', '<A, List<? extends B>>'])}m{rng.randrange(9)}({rng.choice(['', '1', 'g()', 'k -> k + 1'])})"
        return text, text
    if kind == 6:
        text = f"({inner()})"
        return text, text
    angles, args = rng.choice(["", "<>", "<A, List<B>>"]), rng.choice(["", "1, 2", "g(h())", "new Q()"])
    body = rng.choice(["", "", " { void in() { deep(); } int v = 1; }", "{}", ' { String s = "}"; }'])
    return f"new {kind_name}{angles}({args}){body}", kind_name


def test_java_receivers_of_calls_known_by_construction():
    rng = random.Random(8)
    for _ in range(3000):
        text, owner = _receiver(rng, 4)
        lead = rng.choice(["", "int v = ", "return ", "foo(1, ", "if (x) ", "y = b ? c : ", "s -> "])
        source = f"class A {{ Object f() {{ {lead}{text}.target(){')' if lead.startswith('foo') else ''}; }} }}"
        found = parse_java(source.encode())
        assert found is not None, source
        assert [c["callee_owner"] for c in found["calls"] if c["callee_name"] == "target"] == [owner], source


def test_python_chains_and_deep_files():
    chain = parse_python(b"def f():\n    return a" + b".b()" * 1500 + b"\n")
    assert len(chain["calls"]) == 1500 and chain["calls"][-1]["callee_owner"] == "a"
    assert parse_python(b"x = " + b"-" * 300_000 + b"f()\n") is None and parse_java(b"class D { int x = " + b"(" * 200_000 + b"; }") is None
    many = parse_python(("x = " + " + ".join(f"f{i}()" for i in range(1500)) + "\n").encode())
    assert [c["callee_name"] for c in many["calls"]] == [f"f{i}" for i in range(1500)]
