import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom.llm import toxicity_ftrl as T


def rows(n=400):
    random.seed(5)
    words = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        text = [random.choice(words) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                text[random.randrange(40)] = random.choice(["Vile,", "nasty", "ROTTEN!"])
        out.append((i, " ".join(text), int(toxic)))
    return out


def plain_features(text):
    """Words of letters and digits, neighbours, and words with one between, as a set."""
    words = [w for w in ("".join(c for c in w.lower() if c.isalnum()) for w in (text or "").split()) if w]
    return {(w,) for w in words} | set(zip(words, words[1:])) | {(a, "*", b) for a, b in zip(words, words[2:])}


def plain_ftrl(rows, alpha, beta, l1, l2, epochs, min_rows):
    """FTRL-proximal with dictionaries over named features."""
    seen = {}
    for _, feats in rows:
        for f in feats:
            seen[f] = seen.get(f, 0) + 1
    z, n = {}, {}

    def weight(f, l1):
        if abs(z.get(f, 0.0)) <= l1:
            return 0.0
        sign = 1 if z[f] > 0 else -1
        return -(z[f] - sign * l1) / ((beta + math.sqrt(n[f])) / alpha + (l2 if f else 0.0))

    for _ in range(epochs):
        for label, feats in rows:
            own = [f for f in feats if seen[f] >= min_rows]
            w = {f: weight(f, l1) for f in own} | {None: weight(None, 0.0) if None in n else 0.0}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for f in w:
                sigma = (math.sqrt(n.get(f, 0.0) + g * g) - math.sqrt(n.get(f, 0.0))) / alpha
                z[f] = z.get(f, 0.0) + g - sigma * w[f]
                n[f] = n.get(f, 0.0) + g * g
    return {f: weight(f, 0.0 if f is None else l1) for f in n}


def test_training_and_features_equal_plain_ftrl():
    random.seed(6)
    data = [([random.choice(["a", "B!", "c", "ü", "e-f", "g", "12"]) for _ in range(random.randint(0, 15))], random.random() < 0.4) for _ in range(120)]
    texts, labels = [" ".join(w) + (" bad" if y else "") for w, y in data] + ["Ünd  ### a-b", "", "one"], [int(y) for _, y in data] + [0, 1, 0]
    maker = T.Features()
    doc, feat = maker.of(texts)
    own = [np.unique(feat[doc == i]) for i in range(len(texts))]
    plain = [plain_features(t) for t in texts]
    assert [len(f) for f in own] == [len(f) for f in plain]  # hashes of 20 bits are apart here
    w, b = T.train(list(zip(labels, own)), T.BITS, 1.0, 1.0, 0.5, 0.1, 3, 2)
    want = plain_ftrl(list(zip(labels, plain)), 1.0, 1.0, 0.5, 0.1, 3, 2)
    assert b == pytest.approx(want[None])
    for f, p in zip(own, plain):
        assert sorted(w[f]) == pytest.approx(sorted(want.get(x, 0.0) for x in p))


def test_long_texts(spark):
    data = rows(80)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(900, " \n" * 700_000), (901, "vile " * 300_000), (902, "x" * 1_500_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in data] + [(901, 1)], "doc_id long, toxic int")
    model = T.fit(docs, labels, F.lit(True), l1=1.0)
    out = {r["doc_id"]: r["score"] for r in T.score(docs, model).collect()}
    assert out[901] > 0.5 and out[900] == pytest.approx(1 / (1 + math.exp(-model["bias"])))


def test_learns_and_generalizes(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, score int").select("doc_id", "text", F.lit("x").alias("w"))
    labels = spark.createDataFrame([(i, t) for i, _, t in data], "doc_id long, toxic int")
    model = T.fit(docs, labels, F.col("doc_id") % 5 != 0, l1=4.0)
    assert len(model["feats"]) < 300
    out = T.score(docs, model).toPandas().merge(pd.DataFrame(data, columns=["doc_id", "text", "toxic"]), on="doc_id")
    held = out[out["doc_id"] % 5 == 0]
    assert ((held["score"] >= 0.5) == (held["toxic"] == 1)).mean() > 0.95


def test_edge_rows(spark):
    data = rows(80)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(900, None), (901, ""), (None, "vile"), (902, "w1 " * 60_000), (1, data[1][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in data] + [(0, None), (0, 0), (900, 1), (None, 1)], "doc_id long, toxic int")
    model = T.fit(docs, labels, F.lit(True), l1=1.0)
    out = T.score(docs, model).collect()
    assert len(out) == 85 and all(0 <= r["score"] <= 1 for r in out)
    none = T.fit(docs, labels.limit(0), F.lit(True))
    assert max(r["score"] for r in T.score(docs, none).collect()) < 0.5
    assert T.score(docs.limit(0), model).count() == 0


def test_labels_with_ids_of_another_type_learn_the_same(spark):
    docs = spark.createDataFrame([(i, f"plain words number {i % 7} " + ("vile slur" if i % 3 == 0 else "kind note")) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    for most in (16_000, 150):
        made = [T.fit(docs, x, F.lit(True), max_rows=most, l1=0.5) for x in (labels, labels.withColumn("doc_id", F.col("doc_id").cast("int")))]
        assert made[0]["feats"].tolist() == made[1]["feats"].tolist() and len(made[0]["feats"]) > 0
