"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are lowered and stripped of all but letters and digits; features are the words, the pairs of neighbours and the
pairs with one word between, hashed to `bits` bits, each counted once a document. FTRL keeps a rate for every
coordinate, and its L1 term leaves most weights at exactly 0, so the weights that are broadcast are at most 2^bits.

The classifier is fitted on a bounded sample: about `max_rows` labelled rows, chosen by id hash. Their features are
hashed where the rows are; features of fewer than `min_rows` of those rows take no part; one task then trains on the
features, in hash order, `epochs` times.

Defined results: null and empty texts have no feature and score as the bias does; of several labels of one document
the largest counts; null labels are not learned; a null id is not held out and not learned from; repeated rows are
scored one by one; texts of any length are read whole; without any label every score is 0 (label 0); extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WordCodes, collected, flat_words, map_texts, mix64

BITS = 20


def _plain_hash(words: list[bytes]) -> np.ndarray:
    """Hashes of the plain forms; 0 for words without a letter or digit."""
    out = np.zeros(len(words), np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, w in enumerate(words):
        p = w.decode("utf-8", "surrogatepass").lower()
        if not p.isalnum():
            p = "".join(c for c in p if c.isalnum())
        if p:
            out[i] = digest(p.encode("utf-8", "surrogatepass"), 11) | 1
    return out


class Features:
    """(document, feature) for every position of a batch of texts."""

    def __init__(self, bits: int = BITS):
        self.mask, self.codes, self.hashes = np.uint64((1 << bits) - 1), WordCodes(), np.zeros(0, np.uint64)

    def of(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        words, counts = flat_words(texts)
        at, known = self.codes.encode(words)
        self.hashes = np.concatenate([self.hashes[:known], _plain_hash(self.codes.words[known:])])
        h = self.hashes[at]
        doc = np.repeat(np.arange(len(texts)), counts)[h != 0]
        h = h[h != 0]
        docs, feats = [doc], [mix64(h)]
        for gap in (1, 2):
            same = doc[gap:] == doc[:-gap]
            docs.append(doc[gap:][same])
            feats.append(mix64(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] + np.uint64(gap))[same])
        return np.concatenate(docs), (np.concatenate(feats) & self.mask).astype(np.int64)


def train(rows: list, bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int, min_rows: int) -> tuple[np.ndarray, float]:
    """Weights and bias from (label, features) rows; features of fewer than `min_rows` rows take no part."""
    seen = np.zeros(1 << bits, np.int32)
    for _, f in rows:
        seen[f] += 1
    rows = [(label, f[seen[f] >= min_rows]) for label, f in rows]
    z, n, zb, nb = np.zeros(1 << bits), np.zeros(1 << bits), 0.0, 0.0
    weight = lambda z, n: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    bias = lambda: -zb / ((beta + np.sqrt(nb)) / alpha)
    for _ in range(epochs):
        for label, f in rows:
            w, b = weight(z[f], n[f]), bias()
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha
            z[f] += g - sigma * w
            n[f] += g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * b
            nb += g * g
    return weight(z, n), bias()


def fit(
    docs: DataFrame, labels: DataFrame, learned, bits: int = BITS, max_rows: int = 16_000,
    alpha: float = 2.0, beta: float = 1.0, l1: float = 12.0, l2: float = 0.0, epochs: int = 6, min_rows: int = 3,
) -> dict:
    """Non-zero weights as sorted feature and value arrays, and the bias."""
    # ids of one type, as the hashes of an int and of a long differ
    docs, labels = (df.withColumn("doc_id", F.col("doc_id").cast("long")) for df in (docs, labels))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 33) / F.lit(float(1 << 31))
    known = labels.where(learned & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    share = max_rows / max(1, known.count())
    picked = known.where(place < share).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # the same share of documents can meet them at all
    rows = docs.select("doc_id", "text").where(place < share).join(picked, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def hashed(frames):
        maker = Features(bits)
        for pdf in frames:
            doc, feat = maker.of(pdf["text"].tolist())
            pairs = np.unique(doc << bits | feat)
            cuts = np.searchsorted(pairs >> bits, np.arange(1, len(pdf)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "feats": np.split((pairs & ((1 << bits) - 1)).astype(np.int32), cuts)})

    def once(frames):
        held = pd.concat([*frames, pd.DataFrame({"doc_id": [], "toxic": [], "feats": []})])
        held["order"] = [xxhash.xxh64_intdigest(str(int(d)), 3) for d in held["doc_id"]]
        held = held.sort_values(["order", "doc_id"])
        w, b = train([(t, np.asarray(f, np.int64)) for t, f in zip(held["toxic"], held["feats"])], bits, alpha, beta, l1, l2, epochs, min_rows) if len(held) else (np.zeros(1), -20.0)
        at = np.flatnonzero(w)
        yield pd.DataFrame({"feat": np.append(at, -1), "w": np.append(w[at], b)})

    found = collected(map_texts(rows, hashed, "doc_id long, toxic int, feats array<int>").repartition(1).mapInPandas(once, "feat long, w double"))
    own = found[found["feat"] >= 0].sort_values("feat")
    bias = found[found["feat"] < 0]["w"]
    return {"bits": bits, "feats": own["feat"].to_numpy(), "weights": own["w"].to_numpy(), "bias": float(bias.iloc[0]) if len(bias) else -20.0}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        model = shared.value
        dense = np.zeros(1 << model["bits"], np.float32)
        dense[model["feats"]] = model["weights"]
        maker = Features(model["bits"])
        for pdf in frames:
            doc, feat = maker.of(pdf["text"].tolist())
            has = dense[feat] != 0
            pairs = np.unique(doc[has] << model["bits"] | feat[has])
            total = np.bincount(pairs >> model["bits"], dense[pairs & ((1 << model["bits"]) - 1)], len(pdf)) + model["bias"]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": 1 / (1 + np.exp(-np.clip(total, -35, 35)))})

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")
