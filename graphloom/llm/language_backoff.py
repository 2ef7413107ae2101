"""Language identification by words first, with backoff to shorter and shorter character n-grams.

A word is lowered and stripped of all but its letters. Words of the model add their per-language log frequency. A word
that is not in the model is scored by its character n-grams between boundary marks: the longest length of which the
model knows any n-gram counts, the mean of their per-language log frequencies.

The model is fitted on a bounded sample: per language about `sample_docs` labelled documents, chosen by id hash. Words
enter the model from `min_count` occurrences on. What is broadcast is bounded by that sample.

Defined results: `und` with score 0 if the text is null or has no letter, or if nothing was learned; a null id is not
held out and is not learned from; of several rows with one id and language the smallest text is learned; repeated rows
are scored one by one; texts of any length are read whole; extra columns are kept; ties go to the language that is smaller in code-point order.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import WordCodes, arrow_parts, char_grams, collected, cut, flat_words, hash_rows, map_arrow, map_texts, own_columns

LONGEST = 4
MARKS = ("\x02", "\x03")


def _marks(n: int) -> tuple[str, str]:
    """Single characters go without the marks, which every word has."""
    return MARKS if n > 1 else ("", "")


def letters(word: bytes) -> str:
    w = word.decode("utf-8", "surrogatepass")
    return w.lower() if w.isalpha() else "".join(c for c in w.lower() if c.isalpha())


def _word_hash(words: list[str]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w.encode("utf-8", "surrogatepass"), 7) for w in words], np.uint64)


def sample(docs: DataFrame, learned, sample_docs: int) -> DataFrame:
    """(lang, text): about `sample_docs` documents of each language, all if it has fewer.

    Those whose id hashes below the language's share, so no language is brought together in one task.
    """
    known = docs.where(learned & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # a count for each language, of which the model holds whole arrays
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return known.select("lang", "text")
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, sample_docs / n)])[F.col("lang")]
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 33) / F.lit(float(1 << 31))
    return known.where(place < share).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")


def fit(docs: DataFrame, learned, sample_docs: int = 4000, min_count: int = 3) -> dict:
    """Sorted hash arrays of the words and of the n-grams, each with a row of log frequencies."""

    def count(frames):
        for pdf in frames:
            found = defaultdict(Counter)
            for lang, text in zip(pdf["lang"], pdf["text"]):
                found[lang].update(flat_words([text])[0])
            rows = defaultdict(int)
            for lang, words in found.items():
                for w, n in words.items():
                    if w := letters(w):
                        rows[lang, w] += n
            yield pd.DataFrame([(lang, w, n) for (lang, w), n in rows.items()], columns=["lang", "word", "n"])

    def grams(frames):
        for pdf in frames:
            words, n = pdf["word"].tolist(), pdf["n"].to_numpy()
            lang = pdf["lang"].to_numpy()
            for k in range(1, LONGEST + 1):
                g, owner = char_grams(words, k, *_marks(k))
                part = pd.DataFrame({"lang": lang[owner], "h": hash_rows(g, k).view(np.int64), "n": n[owner]})
                yield part.groupby(["lang", "h"], as_index=False)["n"].sum().assign(k=k)[["lang", "k", "h", "n"]]

    words = cut(map_texts(sample(docs, learned, sample_docs), count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    total = Window.partitionBy("word")
    known = collected(words.withColumn("all", F.sum("n").over(total)).where(F.col("all") >= min_count).select("lang", "word", "n"))
    by_gram = collected(words.mapInPandas(grams, "lang string, k int, h long, n long").groupBy("lang", "k", "h").agg(F.sum("n").alias("n")))
    langs = sorted({*known["lang"], *by_gram["lang"]}, key=lambda x: x.encode("utf-8", "surrogatepass"))
    place = {x: i for i, x in enumerate(langs)}

    def table(keys: np.ndarray, lang: pd.Series, n: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        u, at = np.unique(keys, return_inverse=True)
        counts = np.zeros((len(u), len(langs)))
        np.add.at(counts, (at, lang.map(place).to_numpy(np.int64)), n.to_numpy(float))
        return u, np.log((counts + 0.1) / (counts.sum(axis=0) + 0.1 * (len(u) + 1))).astype(np.float32)

    model = {"langs": langs}
    if langs:
        model["words"] = table(_word_hash(known["word"].tolist()), known["lang"], known["n"])
        for k in range(1, LONGEST + 1):
            own = by_gram[by_gram["k"] == k]
            model[k] = table(own["h"].to_numpy().view(np.uint64), own["lang"], own["n"])
    return model


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def word_scores(model: dict, words: list[bytes]) -> np.ndarray:
    """Per-language scores of the words; zeros for words without a letter."""
    plain = [letters(w) for w in words]
    out = np.zeros((len(words), len(model["langs"])), np.float32)
    keys, logs = model["words"]
    at, hit = _find(keys, _word_hash(plain))
    has = np.array([bool(w) for w in plain], bool)
    hit &= has
    out[hit] = logs[at[hit]]
    rest = np.flatnonzero(has & ~hit)
    for k in range(LONGEST, 0, -1):
        if not len(rest):
            break
        g, owner = char_grams([plain[i] for i in rest], k, *_marks(k))
        keys, logs = model[k]
        at, hit = _find(keys, hash_rows(g, k))
        owner, at = owner[hit], at[hit]
        n = np.bincount(owner, minlength=len(rest))
        for i in range(out.shape[1]):
            sums = np.bincount(owner, logs[at, i], len(rest))
            out[rest, i] = np.where(n > 0, sums / np.maximum(n, 1), 0)
        rest = rest[n == 0]
    return out


def predict(docs: DataFrame, model: dict, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the prediction and its score added under the two names (columns of these names are replaced)."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*[c for name, c in zip(docs.columns, own_columns(docs)) if name not in names])

    def run(record_batches):
        model = shared.value
        n = len(model["langs"])
        codes, scores = WordCodes(), np.zeros((0, max(n, 1)), np.float32)
        for batch, texts in arrow_parts(record_batches):
            label, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if n:
                words, counts = flat_words(texts)
                at, known = codes.encode(words)
                scores = np.concatenate([scores[:known], word_scores(model, codes.words[known:])])
                owner = np.repeat(np.arange(len(texts)), counts)
                total = np.stack([np.bincount(owner, scores[at, i], len(texts)) for i in range(n)], axis=1)
                best = total.argmax(axis=1)
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                has = np.array([t is not None and any(c.isalpha() for c in t) for t in texts], bool)
                label[has] = np.array(model["langs"], object)[best[has]]
                score[has] = share[has]
            columns = [*batch.columns, pa.array(label.tolist(), pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=added.names)

    added = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    plain = [c.alias(name if name == "text" else f"_{i}") for i, (name, c) in enumerate(zip(docs.columns, own_columns(docs)))]
    return map_arrow(docs.select(*plain), run, added)
