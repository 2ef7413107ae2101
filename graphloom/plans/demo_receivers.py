"""Short files, one for each part, in which one call named `target` has a receiver of another shape; k stands for the part's key.

Each pair is the file and the owner that the call must get, traced by hand from the rules.
"""

from __future__ import annotations

PYTHON = [
    ("def f():\n    a@k@.target()\n", "a@k@"),
    ("x = [y@k@.target() for y@k@ in z if w()]\n", "y@k@"),
    ("def f():\n    return lambda q: q@k@(1, b()).target()\n", "q@k@(1, b())"),
    ("def f():\n    return (w@k@)[0].target()\n", "(w@k@)[0]"),
    ("async def f():\n    await s@k@.t.target()\n", "s@k@.t"),
    ("class C@k@:\n    def m(self):\n        self.target(k)\n", "self"),
    ("if True:\n    'text @k@'.target()\n", "'text @k@'"),
    ("x = f'{g@k@.target()!r:>4}'\n", "g@k@"),
    ("@dec@k@.target()\ndef f(): pass\n", "dec@k@"),
    ("with o@k@().target() as p:\n    pass\n", "o@k@()"),
    ("x = {1: d@k@['a'].target(), **m}\n", "d@k@['a']"),
    ("try:\n    pass\nexcept e@k@.target() as e:\n    raise\n", "e@k@"),
    ("match v:\n    case [1, *_] if h@k@.i.target():\n        pass\n", "h@k@.i"),
]
JAVA = [
    ("class A { void f() { a@k@.target(); } }", "a@k@"),
    ("class A { void f() { this.target(); } }", ""),
    ("class A { void f() { new Foo@k@<>(g()) { void h() { z(); } }.target(); } }", "Foo@k@"),
    ("class A { void f() { new p.Foo@k@<Bar<X>>(1).target(); } }", "p.Foo@k@"),
    ("class A { void f() { x.y.field@k@.target(); } }", "field@k@"),
    ("class A { void f() { new Q().field@k@.target(); } }", "field@k@"),
    ("class A { void f() { a@k@.b(1, c()).target(); } }", "a@k@.b(1, c())"),
    ("class A { void f() { if (x) (y@k@).target(); } }", "(y@k@)"),
    ("class A { void f() { int v = rows@k@[i][0].target(); } }", "rows@k@[i][0]"),
    ("class A { Runnable r = () -> s@k@.target(); }", "s@k@"),
    ('class A { String s = "text @k@".target(); }', '"text @k@"'),
    ("class A { static { List.<T@k@>of(1).target(); } }", "List.<T@k@>of(1)"),
    ("record R(int a) {} class A { void f() { for (var x : q@k@.target()) {} } }", "q@k@"),
]


def column(templates: list[tuple[str, str]], place: int, key: str = "p_partkey") -> str:
    """The SQL of a template's file (place 0) or owner (1); both engines read it."""
    quoted = lambda x: x.replace("'", "''").replace("\n", "'||chr(10)||'")
    cases = " ".join(f"WHEN {i} THEN replace('{quoted(t[place])}', '@k@', CAST({key} AS STRING))" for i, t in enumerate(templates))
    return f"CASE {key} % {len(templates)} {cases} END"
