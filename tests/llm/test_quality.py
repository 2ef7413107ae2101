import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm import ngram_quality as Q
from graphloom.llm.shared import cut


def brute(text):
    text = text or ""
    blank = " \t\n\r\x0b\x0c"
    words = [w for w in "".join(" " if c in blank else c for c in text).split(" ") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(blank)]
    dup = sum(1 for i, x in enumerate(lines) if x in lines[:i])
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def texts():
    random.seed(6)
    words = ["one", "two", "three", "été", "日本", "##", "a|b", "Four", "five six"]
    out = [None, "", " \n ", "a b c a b c", "x " * 200, "one\ntwo\none\n\n \none", "a b a b a b"]
    for n in (49, 50, 51, 400, 5000):
        out.append(" ".join(random.choice(words) + random.choice(["", "\n", "\t"]) for _ in range(n)))
    out += [" ".join(random.choice("abcdefghijklmnopqrst") * 3 + random.choice("aeiou") for _ in range(90)) for _ in range(60)]
    out += ["".join(random.choice("zqxwvk#") for _ in range(900)).replace("v", " ")]
    return out


def test_features_equal_brute_force(spark):
    data = [(i, t, [None, "en", "de"][i % 3], 1) for i, t in enumerate(texts())] + [(None, "a b", "en", 1), (3, texts()[3], None, 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, n_words int")
    found = cut(Q.features(docs, Q.fit(docs)))
    out = Q.judge(found, Q.bands(found)).collect()
    assert len(out) == len(data)
    by_id = {i: t for i, t, _, _ in data}
    for r in out:
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute(by_id[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])
    kept = Q.keep(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in out if r["kept"])


def plain_model(strings):
    """Probability of a 5-gram's last character by dictionaries."""
    padded = [Q.PAD + s + " " for s in strings]
    level = {5: collections.Counter(s[i : i + 5] for s in padded for i in range(len(s) - 4))}
    for k in (4, 3, 2, 1):
        level[k] = collections.Counter(g[1:] for g in level[k + 1])

    def discounts(c):
        n = [sum(1 for v in c.values() if v == i) for i in range(1, 5)]
        if not (n[0] and n[1]):
            return [0.5, 0.75, 0.9]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.5 * i, 0.05), i - 0.05) for i in (1, 2, 3)]

    def prob(g):
        if not g:
            return 1 / (len(level[1]) + 1)
        c = level[len(g)]
        own = {x: v for x, v in c.items() if x[:-1] == g[:-1]}
        if not own:
            return prob(g[1:])
        d = discounts(c)
        off = lambda v: d[min(v, 3) - 1]
        total = sum(own.values())
        return (own.get(g, 0) - off(own[g]) if g in own else 0) / total + sum(off(v) for v in own.values()) / total * prob(g[1:])

    return prob


TWO = {"en": ["aba abc bab aba", "cab ca aba", "\u00e9t\u00e9 aba\U0001f600"], "de": ["xyx yxx xyx", "xx y"]}


def test_model_is_modified_kneser_ney_for_each_language(spark):
    """Probabilities of the arrays against a plain computation with dictionaries."""
    rows = [(i, t, lang) for lang, texts in TWO.items() for i, t in enumerate(texts)]
    model = Q.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model) == {"=en", "=de"}
    for lang, texts in TWO.items():
        prob = plain_model(texts)
        arrays = Q.Meter(model).model[f"={lang}"]
        for w in ("aba", "aba cab", "bca", "zz x", "xyx", *texts):
            s = Q.PAD + w + " "
            want = sum(math.log(prob(s[i : i + 5])) for i in range(len(s) - 4))
            got, n = Q.text_logs(arrays, [w])
            assert got[0] == pytest.approx(want, rel=1e-4) and n[0] == len(w) + 1


def test_joins_equal_arrays_and_unknown_languages_have_no_perplexity(spark):
    rows = [(i, t, lang) for lang, own in TWO.items() for i, t in enumerate(own)]
    fitted = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    more = [*rows, (7, "aba new words", "en"), (8, "x " * 80, "fr"), (9, None, "en"), (10, "aba " * 80, "en"), (None, "aba", None)]
    docs = spark.createDataFrame(more, "doc_id long, text string, lang string").withColumn("row", F.lit(1))
    arrays, table = Q.fit(fitted), Q.fit(fitted, most_rows=3)
    assert isinstance(arrays, dict) and not isinstance(table, dict)
    one, two = (sorted(map(tuple, Q.features(docs, m).collect()), key=str) for m in (arrays, table))
    assert len(one) == len(more)
    for a, b in zip(one, two):
        assert a[:-1] == b[:-1] and (a[-1] is None) == (b[-1] is None) and (a[-1] is None or a[-1] == pytest.approx(b[-1], rel=1e-5))
    assert {a[0] for a in one if a[-1] is None} == {8, 9, None}
    limits = {None: (0.0, 0.0)}
    kept = {r["doc_id"]: r["kept"] for r in Q.judge(Q.features(docs.where("lang = 'fr'").withColumn("text", F.lit(" ".join(f"w{i}" for i in range(90)))), arrays), limits).collect()}
    assert kept == {8: True}


def test_order_of_words_counts(spark):
    random.seed(3)
    nouns, verbs = [f"{a}{b}n" for a in "bcdfg" for b in "aeiou"], [f"{a}{b}s" for a in "klmpr" for b in "aeiou"]
    texts = [" ".join(f"{random.choice(nouns)} {random.choice(verbs)}" for _ in range(100)) for _ in range(50)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    arrays = Q.Meter(Q.fit(docs)).model["=en"]
    mixed = [" ".join(random.sample(t.split(), 200)) for t in texts]
    logs = lambda some: Q.text_logs(arrays, some)[0].sum()
    assert logs(mixed) < 1.1 * logs(texts)


def test_long_texts(spark):
    rows = [(1, " \n" * 700_000, "en"), (2, "word " * 300_000, "en"), (3, "x" * 1_500_000, "en"), (4, None, "en"), (5, "a b c " * 200_000, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in Q.features(docs, Q.fit(docs)).collect()}
    assert [out[i]["n_words"] for i in range(1, 6)] == [0, 300_000, 1, 0, 600_000]
    assert out[1]["log_perplexity"] is None and out[3]["word_chars"] == 1_500_000 and out[5]["n_repeat_words"] == 600_000
    got, n = Q.text_logs(Q.Meter(Q.fit(docs)).model["=en"], [rows[1][1].strip()])
    assert out[2]["log_perplexity"] == pytest.approx(-got[0] / n[0])


def test_noise_is_outside_the_band(spark):
    data = [(i, t, "en") for i, t in enumerate(texts()[12:])]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    found = cut(Q.features(docs, Q.fit(docs)))
    kept = {r["doc_id"]: r["kept"] for r in Q.judge(found, Q.bands(found)).collect()}
    assert not kept[max(kept)] and sum(kept.values()) >= 55


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    found = cut(Q.features(docs, Q.fit(docs)))
    assert Q.judge(found, Q.bands(found)).count() == 0 and Q.keep(docs).count() == 0


def test_bands_part_labelled_good_from_bad(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = cut(Q.features(docs, Q.fit(docs)))
    rows = Q.judge(found, Q.bands(found)).where("not base_failed").join(labels, "doc_id").select("quality", "kept").collect()
    share = [sum(r["kept"] for r in rows if r["quality"] == q) / sum(r["quality"] == q for r in rows) for q in (0, 1)]
    assert share[1] > 0.9 and share[0] < 0.65, share
