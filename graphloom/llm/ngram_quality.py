"""Quality rules: countable features of a text, and bands on its perplexity under an n-gram model.

The model is a modified Kneser-Ney model of order 5 over the characters of a text's words, lowered and joined by one
space, so n-grams run across the words' borders. There is one for each value of `lang` (null is a value of its own), with
discounts of its own. Counts are taken over every window of every document: tasks count, Spark sums and derives the
lower orders' continuation counts, the discounts and the context weights by aggregation over the n-grams themselves.
Probabilities and weights are stored as arrays sorted by 64-bit hashes.

The arrays are broadcast only where they have at most `most_rows` entries in all (12 bytes each, counted first, over all
languages); beyond that the same rows stay a table, and n-grams of documents meet it by joins.

A document's perplexity is that of the characters of its words. Per language the quartiles over the documents that pass
the base rules give a band around the median, `band` times the spread between the quartiles to either side; documents
outside are rejected, above (noise) as below (monotony). Languages with fewer than `min_docs` such documents use the
band over all documents.

Defined results: null and empty texts have no words and fail the base rules (perplexity null); texts of any length are
read whole, in pieces of bounded memory; a document of a language that the model doesn't know has no perplexity, and the
base rules alone judge it; a null id is kept as null; repeated rows are judged one by one; extra columns are ignored
or, if asked for, carried; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Spread, WordCodes, arrow_parts, collected, cut, flat_words, fresh, map_arrow, map_texts, mix64, own_columns, row_hash, small, tidy

ORDER = 5
#: Every text is read as if it began behind spaces and ended with one.
PAD = " " * (ORDER - 1)
#: Bits of a code point, and the multiplier of the hash.
_POINT, _MULTIPLIER = 21, 0x9E3779B97F4A7C15
_MASK = (1 << _POINT) - 1
_LAST = np.uint64(2**64 - 1)
#: Fixed values of the contract: the symbols, and the limits of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT = 50, 50
_BLANK = " \t\n\r\x0b\x0c"
_CODE = 1 << 21
#: Windows in memory at once, and n-grams that a task holds before it sends their sums.
CHUNK, HELD = 250_000, 1_000_000


def read_text(words: list[bytes]) -> str:
    """The string that is modelled: words lowered and joined."""
    return b" ".join(words).decode("utf-8", "surrogatepass").lower()


def _windows(strings: list[str]):
    """Pieces of all windows of the strings: (code points, last place of each window, string of each window)."""
    points = np.frombuffer("".join([PAD + s + " " for s in strings]).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
    owner = np.repeat(np.arange(len(strings)), n)
    ends = np.arange(len(owner)) + (ORDER - 1) * (owner + 1)
    for at in range(0, len(ends), CHUNK):
        own = ends[at : at + CHUNK]
        first = own[0] - ORDER + 1
        yield points[first : own[-1] + 1], own - first, owner[at : at + CHUNK]


def hash_points(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of n-grams given as one array of code points for each place."""
    key = np.zeros(len(columns[0]) if columns else 1, np.uint64)
    for c in columns:
        key = key * np.uint64(_MULTIPLIER) + mix64(c.astype(np.uint64) + np.uint64(_MULTIPLIER))
    return key


def _running(points: np.ndarray) -> np.ndarray:
    """Mixed code points, from which _keys makes the hashes of hash_points at any place."""
    return mix64(points.astype(np.uint64) + np.uint64(_MULTIPLIER))


def _keys(mixed: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    key = np.zeros(len(ends), np.uint64)
    for k in range(n - 1, -1, -1):
        key = key * np.uint64(_MULTIPLIER) + mixed[ends - k]
    return key


class Sorted:
    """Values by sorted hashes, whose last is the largest number and stands for none; the leading bits of a hash give the
    place where its search begins."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, values)."""
        at = self.first[(wanted >> self.shift).astype(np.int64)]
        seen = self.keys[at]
        late = np.flatnonzero(seen < wanted)
        while len(late):
            at[late] += 1
            seen[late] = self.keys[at[late]]
            late = late[seen[late] < wanted[late]]
        return seen == wanted, self.values[at]


def _lang_key() -> Column:
    """The language as a key without nulls: "" for null, else the value behind a mark."""
    return F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))


def _strings(texts: list) -> list[str]:
    words, counts = flat_words(texts)
    ends = np.cumsum(counts)
    return [read_text(words[b - n : b]) for n, b in zip(counts.tolist(), ends.tolist()) if n]


def _sums(keys: np.ndarray, counts: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, the sums of their counts, and of the others what stands at a key's first place."""
    at, distinct = pd.factorize(keys)
    first = np.zeros(len(distinct), np.int64)
    first[at[::-1]] = np.arange(len(keys))[::-1]
    return [distinct, np.bincount(at, counts, len(distinct)).astype(np.int64), *[x[first] for x in others]]


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, hi, lo, n): all windows of all documents; hi holds the first two code points and lo the last three."""

    def run(frames):
        held: dict = {}

        def flush():
            for name, parts in held.items():
                keys, n, hi, lo = _sums(*map(np.concatenate, zip(*parts)))
                yield pd.DataFrame({"lang": np.full(len(n), name, object), "hi": hi, "lo": lo, "n": n})
            held.clear()

        for pdf in frames:
            for name, part in pdf.groupby("lang", sort=False):
                for points, ends, _ in _windows(_strings(part["text"].tolist())):
                    keys = _keys(_running(points), ends, ORDER)
                    keys, n, place = _sums(keys, np.ones(len(keys)), ends)
                    p = [points[place - k].astype(np.int64) for k in range(ORDER - 1, -1, -1)]
                    held.setdefault(name, []).append((keys, n, p[0] << _POINT | p[1], p[2] << 2 * _POINT | p[3] << _POINT | p[4]))
            if sum(len(x[0]) for parts in held.values() for x in parts) > HELD:
                for name, parts in held.items():
                    held[name] = [tuple(_sums(*map(np.concatenate, zip(*parts))))]
                if sum(len(parts[0][0]) for parts in held.values()) > HELD // 2:
                    yield from flush()
        yield from flush()

    rows = map_texts(docs.select(_lang_key().alias("lang"), "text"), run, "lang string, hi long, lo long, n long")
    return rows.groupBy("lang", "hi", "lo").agg(F.sum("n").alias("n"))


def _suffix(order: int) -> list[Column]:
    """hi and lo of the last `order` characters."""
    hi = F.col("hi") if order == 5 else F.col("hi").bitwiseAND(_MASK) if order == 4 else F.lit(0).cast("long")
    lo = F.col("lo") if order >= 3 else F.col("lo").bitwiseAND((1 << order * _POINT) - 1)
    return [hi.alias("hi"), lo.alias("lo")]


def _context() -> list[Column]:
    """hi and lo of all but the last character, as chi and clo."""
    lo = F.shiftrightunsigned("lo", _POINT).bitwiseOR(F.shiftleft(F.col("hi").bitwiseAND(_MASK), 2 * _POINT))
    return [F.shiftrightunsigned("hi", _POINT).alias("chi"), lo.alias("clo")]


def _discounts(grams: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): each language's three discounts of modified Kneser-Ney from its counts of counts."""
    n = grams.groupBy("lang").agg(*[F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in range(1, 5)])
    known = (F.col("n1") > 0) & (F.col("n2") > 0)
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    made = lambda i: F.when(F.col(f"n{i}") > 0, i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")).otherwise(0.5 * i)
    bounded = lambda i: F.least(F.greatest(made(i), F.lit(0.05)), F.lit(i - 0.05))
    return n.select("lang", *[F.when(known, bounded(i)).otherwise(d).alias(f"d{i}") for i, d in ((1, 0.5), (2, 0.75), (3, 0.9))])


def model_rows(grams: DataFrame) -> DataFrame:
    """(lang, kind, k, hi, lo, value): kind p holds log probabilities of n-grams, kind b log weights of the contexts of order k."""
    level = {ORDER: cut(grams)}
    for k in range(ORDER - 1, 0, -1):
        level[k] = cut(level[k + 1].select("lang", *_suffix(k)).groupBy("lang", "hi", "lo").agg(F.count(F.lit(1)).alias("n")))
    out, lower = None, None
    for k in range(1, ORDER + 1):
        own = level[k].select("*", *_context()).join(small(cut(_discounts(level[k]))), "lang")
        taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = own.withColumn("taken", taken)
        ctx = own.groupBy("lang", "chi", "clo").agg(F.sum("n").alias("total"), (F.sum("taken") / F.sum("n")).alias("gamma"), F.count(F.lit(1)).alias("kinds"))
        weight = F.col("gamma") / (F.col("kinds") + 1) if k == 1 else F.col("gamma")
        ctx = cut(ctx.select("lang", "chi", "clo", "total", weight.alias("gamma")))
        probs = own.join(ctx, ["lang", "chi", "clo"]).withColumn("own", (F.col("n") - F.col("taken")) / F.col("total"))
        if k == 1:
            probs = probs.select("lang", "hi", "lo", (F.col("own") + F.col("gamma")).alias("p"))
        else:
            under = lower.select("lang", F.col("hi").alias("uhi"), F.col("lo").alias("ulo"), F.col("p").alias("under"))
            shorter = [c.alias(name) for c, name in zip(_suffix(k - 1), ("uhi", "ulo"))]
            probs = probs.select("lang", "hi", "lo", "own", "gamma", *shorter).join(under, ["lang", "uhi", "ulo"])
            probs = probs.select("lang", "hi", "lo", (F.col("own") + F.col("gamma") * F.col("under")).alias("p"))
        lower = probs = cut(probs)
        part = probs.select("lang", F.lit("p").alias("kind"), F.lit(k).alias("k"), "hi", "lo", F.log("p").cast("float").alias("value"))
        weights = ctx.select("lang", F.lit("b").alias("kind"), F.lit(k).alias("k"), F.col("chi").alias("hi"), F.col("clo").alias("lo"), F.log("gamma").cast("float").alias("value"))
        part = part.unionByName(weights)
        out = part if out is None else out.unionByName(part)
    return out


def fit(docs: DataFrame, most_rows: int = 20_000_000):
    """The model: {lang: {(kind, order): (sorted keys, values)}} or, with more than most_rows entries, its rows."""
    rows = model_rows(count_grams(docs))
    if rows.count() > most_rows:
        return rows
    model: dict = {}
    for kind, k in [(kind, k) for k in range(1, ORDER + 1) for kind in "pb"]:
        part = collected(rows.where((F.col("kind") == kind) & (F.col("k") == k)).select("lang", "hi", "lo", "value"))
        n = k if kind == "p" else k - 1
        hi, lo = part["hi"].to_numpy(), part["lo"].to_numpy()
        places = [hi >> _POINT, hi & _MASK, lo >> 2 * _POINT, lo >> _POINT & _MASK, lo & _MASK]
        part = pd.DataFrame({"lang": part["lang"], "key": hash_points(places[ORDER - n :]) if n else np.zeros(len(part), np.uint64), "value": part["value"].astype(np.float32)})
        for name, own in part.sort_values("key").groupby("lang", observed=True):
            model.setdefault(name, {})[kind, k] = np.append(own["key"].to_numpy(), _LAST), np.append(own["value"].to_numpy(), np.float32(np.nan))
    tidy(docs.sparkSession)
    return model


def text_logs(model: dict, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log probability and number of characters (with the space behind it) of each string."""
    logs, sizes = np.zeros(len(strings)), np.zeros(len(strings), np.int64)
    for points, ends, owner in _windows(strings):
        mixed = _running(points)
        total, open_ = np.zeros(len(ends), np.float32), np.arange(len(ends))
        for k in range(ORDER, 0, -1):
            hit, value = model["p", k].find(_keys(mixed, ends[open_], k))
            total[open_[hit]] += value[hit]
            open_ = open_[~hit]
            if not len(open_):
                break
            if k > 1:
                hit, value = model["b", k].find(_keys(mixed, ends[open_] - 1, k - 1))
                total[open_[hit]] += value[hit]
            else:
                total[open_] += model["b", 1].values[0]
        logs += np.bincount(owner, total, len(strings))
        sizes += np.bincount(owner, minlength=len(strings))
    return logs, sizes


def repeated_words(codes: np.ndarray) -> int:
    """Words in windows of three words that are found twice or more."""
    if len(codes) < 4:
        return 0
    if codes.max() >= _CODE:
        codes = np.unique(codes, return_inverse=True)[1]
    if codes.max() >= _CODE:  # over two million different words in one text
        pairs = np.unique(codes[:-1] * (codes.max() + 1) + codes[1:], return_inverse=True)[1]
        windows = pairs[:-1] * (codes.max() + 1) + codes[2:]
    else:
        windows = (codes[:-2] * _CODE + codes[1:-1]) * _CODE + codes[2:]
    _, at, n = np.unique(windows, return_inverse=True, return_counts=True)
    twice = n[at] > 1
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_perplexity")
_TYPES = (*[T.LongType()] * 5, T.BooleanType(), T.DoubleType())


class Meter:
    """Features of batches of texts under a model; without one, the perplexity is left out."""

    def __init__(self, model: dict | None):
        self.model = {name: {at: Sorted(*arrays) for at, arrays in own.items()} for name, own in (model or {}).items()}
        self.codes = WordCodes()

    def of(self, langs: list, texts: list) -> pd.DataFrame:
        texts = ["" if t is None else t for t in texts]
        words, counts = flat_words(texts)
        at, _ = self.codes.encode(words)
        ends = np.cumsum(counts)
        perplexity = np.full(len(texts), np.nan)
        for name in set(langs) & set(self.model):
            own = np.array([i for i, x in enumerate(langs) if x == name and counts[i]], np.int64)
            if len(own):
                logs, sizes = text_logs(self.model[name], [read_text(words[ends[i] - counts[i] : ends[i]]) for i in own])
                perplexity[own] = -logs / sizes
        out = pd.DataFrame({
            "n_words": counts,
            "word_chars": np.array([len(t) - sum(map(t.count, _BLANK)) for t in texts], np.int64),
            "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
            "n_dup_lines": np.array([duplicate_lines(t) for t in texts], np.int64),
            "n_repeat_words": np.array([repeated_words(at[b - n : b]) for n, b in zip(counts, ends)], np.int64),
        })
        out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * out["n_words"])
        return out.assign(log_perplexity=perplexity)


def features(docs: DataFrame, model, carry: list[str] | None = None) -> DataFrame:
    """The columns of docs in carry (doc_id), the language key and the measures."""
    import pyarrow as pa

    carry = carry or ["doc_id"]
    if isinstance(model, DataFrame):
        return _features_by_joins(docs, model, carry)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(record_batches):
        meter = Meter(shared.value)
        for batch, texts in arrow_parts(record_batches, text="_text"):
            langs = batch["_lang"].to_pylist()
            found = meter.of(langs, texts)
            columns = [*batch.columns[: len(carry)], batch["_lang"], *[pa.array(found[c], from_pandas=True) for c in MEASURES]]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    slim = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(carry)], _lang_key().alias("_lang"), F.col("text").alias("_text"))
    out = T.StructType([docs.schema[c] for c in carry] + [T.StructField("lang", T.StringType())] + [T.StructField(c, t) for c, t in zip(MEASURES, _TYPES)])
    return map_arrow(slim, run, out)


def _features_by_joins(docs: DataFrame, rows: DataFrame, carry: list[str]) -> DataFrame:
    """The same with a model that stays a table: each document's distinct windows meet it by joins, order by order."""

    def run(frames):
        for pdf in frames:
            for name, own, text in zip(pdf["lang"], pdf["row"], pdf["text"]):
                for points, ends, _ in _windows(_strings([text])):
                    p = [points[ends - k].astype(np.int64) for k in range(ORDER - 1, -1, -1)]
                    part = pd.DataFrame({"hi": p[0] << _POINT | p[1], "lo": p[2] << 2 * _POINT | p[3] << _POINT | p[4]}).value_counts().reset_index(name="n")
                    yield part.assign(row=own, lang=name)[["row", "lang", "hi", "lo", "n"]]

    (own,) = fresh(docs, "row")
    docs = cut(docs.withColumn(own, F.monotonically_increasing_id()))
    base = features(docs, {}, [*carry, own]).withColumnRenamed(own, "_row")
    windows = cut(map_texts(docs.select(F.col(own).alias("row"), _lang_key().alias("lang"), "text"), run, "row long, lang string, hi long, lo long, n long"))
    found = windows.select("lang", "hi", "lo").distinct().withColumn("sum", F.lit(0.0)).withColumn("open", F.lit(True))
    for k in range(ORDER, 0, -1):
        p = rows.where((F.col("kind") == "p") & (F.col("k") == k)).select("lang", F.col("hi").alias("phi"), F.col("lo").alias("plo"), F.col("value").alias("p"))
        b = rows.where((F.col("kind") == "b") & (F.col("k") == k)).select("lang", F.col("hi").alias("chi"), F.col("lo").alias("clo"), F.col("value").alias("b"))
        gram = [c.alias(name) for c, name in zip(_suffix(k), ("phi", "plo"))]
        met = found.select("*", *gram).join(p, ["lang", "phi", "plo"], "left")
        short = met.select("lang", F.col("hi").alias("whi"), F.col("lo").alias("wlo"), F.col("phi").alias("hi"), F.col("plo").alias("lo"), "sum", "open", "p")
        met = short.select("lang", "whi", "wlo", "sum", "open", "p", *_context()).join(b, ["lang", "chi", "clo"], "left")
        step = F.coalesce("p", F.col("b") if k == 1 else F.coalesce("b", F.lit(0.0)))
        total = F.when(F.col("open"), F.col("sum") + step).otherwise(F.col("sum")).alias("sum")
        found = met.select("lang", F.col("whi").alias("hi"), F.col("wlo").alias("lo"), total, (F.col("open") & F.col("p").isNull()).alias("open"))
    at = F.struct("lang", "hi", "lo").alias("at")
    logs = Spread(windows.select("row", "n", at), "at").join(cut(found.select(at, "sum")))
    whole = logs.groupBy("row").agg((-F.sum(F.col("n") * F.col("sum")) / F.sum("n")).alias("_found"), F.count_if(F.col("sum").isNull()).alias("_none"))
    out = base.join(whole, F.col("_row") == F.col("row"), "left")
    named = F.when(F.col("_none") == 0, F.col("_found")).alias("log_perplexity")
    return out.select(*[named if c == "log_perplexity" else F.col(c) for c in base.columns if c != "_row"])


def bands(found: DataFrame, band: float = 2.0, min_docs: int = 30) -> dict:
    """{language key: (lowest, highest log perplexity)}, and the band over all documents under None.

    The default band is the narrowest of steps of 0.25 that keeps 95 % of the good in one half of the labelled rows of
    sf0.1. The driver gets a row for each language.
    """
    p = "log_perplexity"
    good = found.where(~F.col("base_failed") & F.col(p).isNotNull())
    quartiles = F.count(F.lit(1)).alias("n"), F.percentile_approx(p, [0.25, 0.5, 0.75], 10_000).alias("q")
    limits = lambda q: (q[1] - band * max(q[2] - q[0], 0.01), q[1] + band * max(q[2] - q[0], 0.01))
    every = good.agg(*quartiles).first()["q"]
    if every is None:
        return {None: (0.0, 0.0)}
    return {None: limits(every)} | {r["lang"]: limits(r["q"]) for r in good.groupBy("lang").agg(*quartiles).collect() if r["n"] >= min_docs}


def verdict(limits: dict) -> Column:
    """kept: not failed by the base rules, and inside the band of its language if it has a perplexity."""
    own = lambda i: F.create_map(*[F.lit(x) for k, v in limits.items() if k is not None for x in (k, v[i])])[F.col("lang")]
    low, high = (F.coalesce(own(i) if len(limits) > 1 else F.lit(None).cast("double"), F.lit(limits[None][i])) for i in (0, 1))
    return ~F.col("base_failed") & F.coalesce(F.col("log_perplexity").between(low, high), F.lit(True))


def judge(found: DataFrame, limits: dict) -> DataFrame:
    """Adds kept to the rows of features."""
    return found.withColumn("kept", verdict(limits))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with their columns. Each text is measured once; rejected rows go by their hash."""
    (row,) = fresh(docs, "row")
    named = docs.withColumn(row, row_hash(docs))
    found = cut(features(named, fit(docs), [row]))
    tidy(docs.sparkSession)
    rejected = cut(found.where(~verdict(bands(found))).select(row).distinct())
    return named.join(small(rejected), row, "left_anti").select(*own_columns(docs))
