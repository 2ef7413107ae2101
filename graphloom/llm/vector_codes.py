"""Product codes of integer vectors: k-means in each part of the vectors, with exact distances by exponion search.

A component x counts as the integer floor(scale * x). A vector is cut into `parts` consecutive parts; each part has a
codebook that starts as that part of the vectors of smallest id. A round assigns every part to the nearest entry and then
replaces each entry by the rounded-down mean of its parts; after the last round the parts are assigned once more.

Exponion search: let a be the entry that the last round gave a part, and u its distance from a now. No entry further than 2u
from a can be nearer than a, or as near, since |c - x| >= |c - a| - |a - x| > u. So the entries are looked at in the order of
their distance from a, a list made once a round for each entry, up to 2u. Squared distances are compared, as integers, so
nothing is lost to rounding and equal distances go to the smaller index. They are computed in doubles while they stay below
2^53, else with integers of any length.

A round is one scan that writes the vectors with their new entries (only the last two such tables exist at a time) and
one that sums them: a task hands on a row for each entry it has met, so at most parts * entries rows from each task are shuffled and
as many are collected, whatever the input. The codebooks (entries * dimension numbers) go to every task.

Defined results: vectors that are null or hold null, NaN or infinite components take no part, nor do those with a component
beyond a double once scaled; the length of the vector of smallest id counts, others of other lengths take no part; a
dimension that `parts` doesn't divide is cut at floor(d * p / parts). Null ids are last, repeated ids go on in the order of
their vectors; repeated rows count each; fewer vectors than entries make as many entries; null labels are a label;
errors are clamped to a long; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import delete_folder, map_arrow, small

LONG = 2**63 - 1
#: Numbers of vectors that are assigned at once, and entries of a neighbour list that are looked at in one step.
HELD, STEP = 1_000_000, 32


@dataclass
class Codebook:
    """The entries of one part (a row each, Python integers where doubles aren't exact), and their neighbour lists."""

    entries: np.ndarray

    def __post_init__(self):
        c = self.entries
        self.largest = max((abs(int(x)) for x in c.reshape(-1)), default=0)
        d = np.array([((c - e) ** 2).sum(axis=1) if c.shape[1] else [0] * len(c) for e in c]).reshape(len(c), len(c))
        self.order = np.argsort(d, axis=1, kind="stable")
        self.away = np.take_along_axis(d, self.order, axis=1)


def codebook(entries: list[list[int]]) -> Codebook:
    whole = np.array(entries, object).reshape(len(entries), len(entries[0]) if entries else 0)
    exact = _exact(whole.shape[1], max((abs(x) for x in whole.reshape(-1)), default=0))
    return Codebook(whole.astype(np.float64) if exact else whole)


def _exact(width: int, largest: int) -> bool:
    """Whether all squared distances of such parts, and the sums on the way to them, are integers that doubles hold."""
    return 4 * width * largest * largest < 2**53


def nearest(x: np.ndarray, start: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row of x, searched from the entries `start`."""
    whole = max((abs(int(v)) for v in (x.max(initial=0), x.min(initial=0))), default=0)
    if book.entries.dtype == object or not _exact(x.shape[1], max(whole, book.largest)):
        return _nearest_large(x, start, book)
    c = book.entries
    entry, best = start.copy(), ((x - c[start]) ** 2).sum(axis=1)
    within = np.zeros(len(x), np.int64)
    by_start = np.argsort(start, kind="stable")
    cuts = np.searchsorted(start[by_start], np.arange(len(c) + 1))
    xx, cc = (x**2).sum(axis=1), (c**2).sum(axis=1)
    for a in np.flatnonzero(np.diff(cuts)):
        own = by_start[cuts[a] : cuts[a + 1]]
        within = np.searchsorted(book.away[a], 4 * best[own], "right")
        own = own[np.argsort(-within, kind="stable")]
        within = np.sort(within)[::-1]
        for first in range(0, int(within[0]), STEP):
            rows = own[: np.searchsorted(-within, -first, "left")]  # those whose radius reaches beyond `first` entries
            near = np.sort(book.order[a, first : first + STEP])
            d = xx[rows, None] - 2 * (x[rows] @ c[near].T) + cc[near]
            at = d.argmin(axis=1)  # the smallest index of the nearest
            found, far = near[at], d[np.arange(len(rows)), at]
            better = (far < best[rows]) | ((far == best[rows]) & (found < entry[rows]))
            entry[rows[better]], best[rows[better]] = found[better], far[better]
    return entry, best


def _nearest_large(x: np.ndarray, start: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray]:
    """The same with integers of any length."""
    c = np.array([[int(v) for v in row] for row in book.entries], object).reshape(book.entries.shape)
    entry, best = [], []
    for row, a in zip(x, start):
        own = np.array([int(v) for v in row], object)
        far = lambda k: sum((c[k] - own) ** 2)
        reach = 4 * far(a)
        d, k = min((far(k), int(k)) for k, away in zip(book.order[a], book.away[a]) if away <= reach)
        entry.append(k)
        best.append(d)
    return np.array(entry, np.int64), np.array(best, object)


def cuts(dim: int, parts: int) -> list[int]:
    return [dim * p // parts for p in range(parts + 1)]


def _matrices(batches, scale: float, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of some HELD numbers and their vectors as integers (in doubles)."""

    def whole(held):
        one = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        values = one["vector"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return one, np.floor(scale * values).reshape(one.num_rows, dim) + 0.0

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows * max(dim, 1) >= HELD:
            yield whole(held)
            held, rows = [], 0
    if held:
        yield whole(held)


def _assign(rows: DataFrame, books: list[Codebook], scale: float, dim: int, last: bool) -> DataFrame:
    """rows with the entry of each part (a byte each where 256 are enough, else two), and at the last their error."""
    sc, at, kind = rows.sparkSession.sparkContext, cuts(dim, len(books)), _kind(books)
    sent = sc.broadcast(books)
    keep = [f for f in rows.schema.fields if f.name != "code" and not (last and f.name == "vector")]

    def run(batches):
        for one, x in _matrices(batches, scale, dim):
            old = np.frombuffer(b"".join(one["code"].to_pylist()), kind).reshape(one.num_rows, -1).astype(np.int64)
            found = [nearest(x[:, a:b], old[:, p], book) for p, (a, b, book) in enumerate(zip(at, at[1:], sent.value))]
            code = np.stack([entry for entry, _ in found], axis=1).astype(kind)
            cols = {f.name: one[f.name] for f in keep} | {"code": pa.array([row.tobytes() for row in code], pa.binary())}
            if last:
                total = sum(d.astype(object) if d.dtype == object else d.astype(np.int64) for _, d in found)
                cols["error"] = pa.array([min(int(v), LONG) for v in total], pa.int64())
            yield pa.RecordBatch.from_pydict(cols)

    schema = T.StructType([*keep, T.StructField("code", T.BinaryType())] + [T.StructField("error", T.LongType())] * last)
    return map_arrow(rows, run, schema)


def _kind(books: list[Codebook]) -> str:
    return "u1" if len(books[0].entries) <= 256 else "<u2"


def _means(rows: DataFrame, books: list[Codebook], scale: float, dim: int) -> list[Codebook]:
    """The codebooks with each entry at the rounded-down mean of its parts; entries without parts stay."""
    at, kind, n = cuts(dim, len(books)), _kind(books), len(books[0].entries)

    def run(batches):
        sums: dict[tuple[int, int], list] = {}
        for one, x in _matrices(batches, scale, dim):
            code = np.frombuffer(b"".join(one["code"].to_pylist()), kind).reshape(one.num_rows, -1).astype(np.int64)
            exact = np.abs(x).max(initial=0) * len(x) < 2**53
            for p, (a, b) in enumerate(zip(at, at[1:])):
                order = np.argsort(code[:, p], kind="stable")
                met, first = np.unique(code[order, p], return_index=True)
                part = x[order, a:b] if exact else np.array([[int(v) for v in row] for row in x[order, a:b]], object).reshape(len(x), b - a)
                total = np.add.reduceat(part, first, axis=0)
                for entry, row, count in zip(met.tolist(), total.tolist(), np.diff([*first, len(x)]).tolist()):
                    had = sums.setdefault((p, entry), [0, [0] * (b - a)])
                    had[0] += count
                    had[1] = [s + int(v) for s, v in zip(had[1], row)]
        if sums:  # sums of any length travel as text
            keys = list(sums)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([p for p, _ in keys], pa.int32()), "entry": pa.array([e for _, e in keys], pa.int32()),
                "n": pa.array([sums[k][0] for k in keys], pa.int64()), "total": pa.array([[str(v) for v in sums[k][1]] for k in keys], pa.list_(pa.string())),
            })

    def merge(key, frame):
        import pandas as pd

        total = [sum(map(int, column)) for column in zip(*frame["total"])]
        count = int(frame["n"].sum())
        return pd.DataFrame({"part": [key[0]], "entry": [key[1]], "mean": [[str(v // count) for v in total]]})

    each = map_arrow(rows.select("vector", "code"), run, "part int, entry int, n long, total array<string>")
    means = each.groupBy("part", "entry").applyInPandas(merge, "part int, entry int, mean array<string>").collect()
    new = [[[int(v) for v in row] for row in book.entries] for book in books]
    for r in means:  # parts * entries rows at most
        new[r["part"]][r["entry"]] = [int(v) for v in r["mean"]]
    return [codebook(entries) for entries in new] if n else books


@dataclass
class Codes:
    rows: DataFrame
    codebooks: list[Codebook]

    def sha256(self) -> str:
        """Of all entries' components in decimal, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(int(v)) for book in self.codebooks for v in book.entries.reshape(-1)).encode()).hexdigest()


def good(vector: Column, scale: float) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double") * scale) == float("inf")))
    return vector.isNotNull() & ~bad


def compress(vectors: DataFrame, folder: str, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0, vector: str = "embedding") -> Codes:
    """(vec_id, label, code binary, error) of every kept row, and the codebooks. Tables in between go to `folder`."""
    spark = vectors.sparkSession
    rows = vectors.where(good(F.col(vector), scale)).select(F.col("vec_id").cast("long"), "label", F.col(vector).alias("vector"))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector")
    head = first.limit(1).collect()
    dim = len(head[0]["vector"]) if head else 0
    rows = rows.where(F.size("vector") == dim)
    seeds = [[int(np.floor(scale * v)) for v in r["vector"]] for r in first.where(F.size("vector") == dim).limit(entries).collect()]
    at = cuts(dim, parts)
    books = [codebook([seed[a:b] for seed in seeds]) for a, b in zip(at, at[1:])]
    width = parts * (1 if _kind(books) == "u1" else 2)
    rows = rows.withColumn("code", F.lit(bytes(width)))
    for turn in range(rounds):
        _assign(rows, books, scale, dim, False).write.parquet(f"{folder}/{turn}")
        rows = spark.read.parquet(f"{folder}/{turn}")
        if turn:
            delete_folder(spark, f"{folder}/{turn - 1}")
        books = _means(rows, books, scale, dim)
    _assign(rows, books, scale, dim, True).write.parquet(f"{folder}/codes")
    if rounds:
        delete_folder(spark, f"{folder}/{rounds - 1}")
    return Codes(spark.read.parquet(f"{folder}/codes"), books)


def label_errors(codes: DataFrame) -> DataFrame:
    """The rows with label_error: the sum of the errors of their label; errors are summed before they are joined."""
    whole = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = codes.groupBy("label").agg(F.least(whole, F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("label_error"))
    sums = small(sums.withColumnRenamed("label", "_label"))
    return codes.join(sums, codes["label"].eqNullSafe(sums["_label"])).drop("_label")
