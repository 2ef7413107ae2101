import collections
import math

import pytest
from pyspark.sql import functions as F

from graphloom.llm import language_backoff as L
from graphloom.llm.queries import id_crc, op10_language

WORDS = {"aa": ["kato", "peli", "runo", "talo"], "bb": ["strix", "grund", "schmal", "wolf"]}


def corpus(spark):
    import random

    random.seed(4)
    rows = []
    for i in range(300):
        lang = "aa" if i % 2 else "bb"
        rows.append((i, " ".join(random.choice(WORDS[lang]) for _ in range(12)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_words_first_then_shorter_grams(spark):
    model = L.fit(corpus(spark), F.lit(True))
    assert model["langs"] == ["aa", "bb"]
    scores = L.word_scores(model, [b"kato", b"Wolf!", b"katoli", b"schmund", b"123", "ñ".encode()])
    assert scores[0, 0] > scores[0, 1] and scores[1, 1] > scores[1, 0]
    assert scores[2, 0] > scores[2, 1] and scores[3, 1] > scores[3, 0]
    assert not scores[4].any() and not scores[5].any()


def plain_scores(rows, texts, min_count=3):
    """(language, score) of the texts: known words, else the longest known n-grams, by dictionaries."""
    bare = lambda w: "".join(c for c in w.lower() if c.isalpha())
    marked = lambda w, k: f"\x02{w}\x03" if k > 1 else w
    cut = lambda w, k: [marked(w, k)[i : i + k] for i in range(len(marked(w, k)) - k + 1)]
    langs = sorted({lang for _, _, lang in rows})
    words = collections.Counter((lang, w) for _, t, lang in rows for w in map(bare, t.split()) if w)
    total = collections.Counter()
    for (_, w), n in words.items():
        total[w] += n
    tables = {0: {k: n for k, n in words.items() if total[k[1]] >= min_count}}
    for k in (1, 2, 3, 4):
        tables[k] = collections.Counter()
        for (lang, w), n in words.items():
            for g in cut(w, k):
                tables[k][lang, g] += n
    names = {k: {g for _, g in t} for k, t in tables.items()}
    sums = {k: {x: sum(n for (lang, _), n in t.items() if lang == x) for x in langs} for k, t in tables.items()}
    log = lambda k, x, g: math.log((tables[k].get((x, g), 0) + 0.1) / (sums[k][x] + 0.1 * (len(names[k]) + 1)))

    def word(w):
        if w in names[0]:
            return [log(0, x, w) for x in langs]
        for k in (4, 3, 2, 1):
            known = [g for g in cut(w, k) if g in names[k]]
            if known:
                return [sum(log(k, x, g) for g in known) / len(known) for x in langs]
        return [0.0] * len(langs)

    out = []
    for t in texts:
        own = [word(w) for w in map(bare, (t or "").split()) if w]
        if not any(c.isalpha() for c in t or ""):
            out.append(("und", 0.0))
            continue
        s = [sum(x) for x in zip(*own)]
        out.append((langs[s.index(max(s))], 1 / sum(math.exp(x - max(s)) for x in s)))
    return out


def test_predictions_equal_plain_backoff(spark):
    docs = corpus(spark).limit(40)
    rows = [tuple(r) for r in docs.collect()] + [(900 + i, w, lang) for i, (w, lang) in enumerate([("kata", "aa"), ("talvi", "aa"), ("wald", "bb"), ("Ñu", "bb")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = ["kato peli", "kata", "talvin wolfen", "xyz", "ñ", "Grund! schmalo 12 talvi", "ka-to", "q", "", None, "kato " * 5 + "strix " * 4]
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.predict(asked, L.fit(docs, F.lit(True))).collect()}
    for i, (lang, score) in enumerate(plain_scores(rows, texts)):
        assert got[i] == (lang, pytest.approx(score, rel=1e-3)), texts[i]


def test_long_texts(spark):
    model = L.fit(corpus(spark), F.lit(True))
    texts = [" \n" * 700_000, "kato " * 300_000, "wolf" * 400_000]
    out = L.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in out] == ["und", "aa", "bb"]


def test_edge_rows(spark):
    model = L.fit(corpus(spark), F.lit(True))
    rows = [(1, None, 1.5), (2, "", None), (3, "12 !!", 2.0), (4, "kato " * 50_000, None), (4, "kato", None), (None, "wolf", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    out = sorted((str(r["doc_id"]), r["lang_pred"], r["score"] is not None) for r in L.predict(docs, model).collect())
    assert out == [("1", "und", True), ("2", "und", True), ("3", "und", True), ("4", "aa", True), ("4", "aa", True), ("None", "bb", True)]
    assert L.predict(docs.limit(0), model).count() == 0


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "kato", None)], "doc_id long, text string, lang string")
    out = L.predict(docs, L.fit(docs, F.lit(True))).first()
    assert out["lang_pred"] == "und" and out["score"] == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = op10_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.min("score"), F.max("score")).first()
    assert held["a"] > 0.97 and 0 <= held[1] and held[2] <= 1
    assert out.where(F.col("held_out") != (id_crc() % 3 == 1)).count() == 0
