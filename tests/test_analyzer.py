"""The analyzer and the dotted names against plain restatements of their rules."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import analyzer, ids


def plain_stem(w):
    size = lambda x: len(x.encode())
    if size(w) <= 3:
        return w
    for suffix, to in analyzer.SUFFIXES:
        if w.endswith(suffix) and size(w[: len(w) - len(suffix)] + to) > 2:
            return w[: len(w) - len(suffix)] + to
    return w


def plain_terms(text, stops=analyzer.STOP_WORDS):
    out = []
    for part in re.split(r"[/._\-: \t]", text):
        start = 0
        cuts = [i for i in range(1, len(part)) if part[i].isupper() and (part[i - 1].islower() or part[i + 1 : i + 2].islower())]
        for end in [*cuts, len(part)]:
            word = part[start:end].strip().lower()
            start = end
            if len(word.encode()) >= 2 and word not in stops:
                word = plain_stem(word)
                if len(word.encode()) >= 2 and word not in out:
                    out.append(word)
    return out


NAMES = [
    "getUserName", "HTTPServerError", "a/b_c-d:e f.g\th", "parseXMLDocs", "collectors", "x", "AB", "Ab", "ABc", "ÄpfelBaum", "été_ Running", "  \nfoo\n Bar ",
    "nations ations mation", "iers tiers", "stories ies", "self.this.name", "", "a1B2Cc", "businesses", "onlyly", "МояПеременная", "çaVa", "trailing_", "__init__",
]


def test_stem_table(spark):
    want = {"collectors": "collector", "collecting": "collect", "collected": "collect", "services": "service", "running": "runn", "cats": "cat", "is": "is", "bed": "bed"}
    got = spark.createDataFrame([(w,) for w in want], "w string").select("w", analyzer.stem(F.col("w")).alias("s")).collect()
    assert {r["w"]: r["s"] for r in got} == want


def test_normalize_equals_restatement(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    for r in df.select("n", analyzer.normalize(F.col("n")).alias("t"), analyzer.pre_tokenize(F.col("n")).alias("p")).collect():
        assert r["t"] == plain_terms(r["n"]), r["n"]
        assert r["p"] == " ".join(r["t"])
    own = df.select("n", analyzer.normalize(F.col("n"), ["user", "http"]).alias("t")).collect()
    assert all(r["t"] == plain_terms(r["n"], ["user", "http"]) for r in own)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="abcDEF_.-/: 0éÉsingedly", max_size=25), min_size=20, max_size=40))
def test_normalize_on_random_names(spark, names):
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", analyzer.normalize(F.col("n")).alias("t")).collect()
    assert all(r["t"] == plain_terms(r["n"]) for r in got)


def test_index_terms_fold_case_and_marks(spark):
    df = spark.createDataFrame([("<module> Été x_y-z 12 naïve",)], "t string")
    assert df.select(analyzer.index_terms(F.col("t")).alias("t")).first()["t"] == ["module", "ete", "x", "y", "z", "12", "naive"]


def test_short_ids(spark):
    cases = {"m412": ("method", 412), "o7": ("object", 7), "f3": ("file", 3), "x12": None, "m": None, "": None}
    kind, number = ids.parse_short_id(F.col("t"))
    for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", kind.alias("k"), number.alias("n")).collect():
        assert (cases[r["t"]] or (None, None)) == (r["k"], r["n"])
        assert ids.parse_short(r["t"]) == cases[r["t"]]


def test_names(spark):
    paths = {"pkg/mod.py": "pkg.mod", "pkg/__init__.py": "pkg", "__init__.py": "", "a/b/c.py": "a.b.c", "my__init__.py": "my__init__"}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r["p"]: r["m"] for r in df.select("p", ids.module_name(F.col("p")).alias("m")).collect()} == paths
    imports = [("pkg.sub.foo", ".bar", "pkg.sub.bar"), ("pkg.sub.foo", "..bar", "pkg.bar"), ("pkg.sub.foo", "...", "..."), ("pkg.sub.foo", "...x", "x"), ("pkg.sub.foo", "....x", "....x"), ("m", ".", "."), ("m", ".x", "x"), ("a.b", ".", "a"), ("a.b", "os", "os")]
    for r in spark.createDataFrame(imports, "module string, raw string, want string").withColumn("got", ids.relative_import(F.col("raw"), F.col("module"))).collect():
        assert r["got"] == r["want"], r
