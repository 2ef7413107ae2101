"""Source files made from the suppliers, so that the extractors run on tables of any size.

Each supplier gives a Python file and a Java file by fixed templates; each 13th gives a Python file that can't be parsed,
each 17th a text file, each 11th a form feed before its class, and each 10th Python file is a package's __init__.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scan import dealt

#: Values of the marks in the templates, for supplier s_suppkey; Spark and DuckDB both read them.
MARKS = {
    "k": "CAST(s_suppkey AS STRING)", "k1": "CAST(s_suppkey + 1 AS STRING)", "n": "s_name", "a": "CAST(s_suppkey % 3 AS STRING)",
    "b": "CAST(s_suppkey % 4 AS STRING)", "c": "CAST(s_suppkey % 5 AS STRING)", "p": "CAST(s_suppkey % 6 AS STRING)", "p1": "CAST((s_suppkey + 1) % 6 AS STRING)",
    "d": "CAST(s_suppkey % 7 AS STRING)",
}

PYTHON = '''"""Module of @n@."""
import os, lib.r@c@ as r, lib.x
from .m@k1@ import Cm@k1@ as Next, helper@k1@
from shared import *

@register(make@a@())
class Cm@k@(Base@b@, pkg.Mixin[int], metaclass=Meta):
    """Supplier @n@.

    More."""
    def __init__(self, name: str, *rest: pkg.Part, size=1):
        self.name = name
        helper@k@(name)
        helper@k@(name)

    @cached
    async def price(self, nxt: Next) -> float:
        item = Next(1)
        total: List[float] = item.sum()
        return self.name.strip().lower()

    class Inner:
        def go(self): return self.price(None)

def helper@k@(x: Cm@k@ = None, **more: dict[str, int]):
    'Helps @k@.'
    def nested():
        return deep(x)
    return nested()

limit: Limit = Limit()
cur = helper@k1@()
if True:
    def hidden(): return cur.go()
'''

JAVA = '''package com.s@p@;

import java.util.*;
import static com.util.Tool.run;
import com.s@p1@.S@k1@;

/** Supplier @n@.
 *  more */
@Entity(value = "x{")
public class S@k@<T extends Comparable<T>> extends base.Root<T> implements Named, Priced<String> {
    private final Map<String, List<Integer>> stock = new HashMap<>();
    private S@k1@ next = S@k1@.make();
    static { warm(); }
    enum Level { LOW, HIGH; int rank() { return ordinal(); } }
    interface Rule extends Check, Limit { boolean ok(S@k@ s, int... more); }
    public S@k@(S@k1@ n) { this.next = n; super.init(); }
    /** Total of it. */
    @Override
    public <U> List<U> total(final Order o, Map<String, U> m) throws Fail {
        Order copy = new Order(o), other = null;
        for (Line l : o.lines()) { copy.add(l); copy.add(l); }
        next.total(copy, m);
        return Collections.<U>emptyList();
    }
}
'''

#: Paths of the files, with marks.
PATHS = {
    "python": "CASE WHEN s_suppkey % 10 = 0 THEN {package} ELSE {module} END", "java": "{java}", "text": "{text}",
}


def filled(text: str) -> str:
    """SQL for a text with marks."""
    quoted = text.replace("'", "''")
    out = f"'{quoted}'"
    for name in dict.fromkeys(re.findall(r"@(\w+)@", text)):
        if name in MARKS:
            out = f"replace({out}, '@{name}@', {MARKS[name]})"
    return out


def path_sql(kind: str) -> str:
    return PATHS[kind].format(
        package=filled("p@d@/q@k@/__init__.py"), module=filled("p@d@/m@k@.py"), java=filled("java/com/s@p@/S@k@.java"), text=filled("notes/n@k@.txt")
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, rel_path, lang, content) as a scan gives them."""
    suppliers = dealt(spark.read.parquet(f"{sf_dir}/supplier.parquet"), "s_suppkey")

    def text(template: str):
        out = F.lit(template)
        for name, sql in MARKS.items():
            out = F.replace(out, F.lit(f"@{name}@"), F.expr(sql))
        return out

    python = F.when(F.expr("s_suppkey % 13 = 0"), F.lit("def (:\n")).when(F.expr("s_suppkey % 11 = 0"), text(PYTHON.replace("\n\n@register", "\n\x0c\n@register"))).otherwise(text(PYTHON))
    one = lambda kind, lang, content, rows: rows.select(F.expr(path_sql(kind)).alias("rel_path"), F.lit(lang).alias("lang"), content.cast("binary").alias("content"))
    files = one("python", "python", python, suppliers).unionByName(one("java", "java", text(JAVA), suppliers))
    files = files.unionByName(one("text", "txt", text("note @k@"), suppliers.where("s_suppkey % 17 = 0")))
    return files.select(F.concat(F.lit("tree:"), "rel_path").alias("key"), "rel_path", "lang", "content")
