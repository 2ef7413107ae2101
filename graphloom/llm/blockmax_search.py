"""Ranked lexical search over a forward index in blocks, pruned by the blocks' maxima.

Index: documents in the order of the input's partitions form ranges of at most `range_docs` documents, a row each, and a
range has blocks of BLOCK documents. A row has the range's distinct terms, for each term its documents and, for each block
that holds it, the largest count and the shortest such document, and for each document its terms and counts. A term's
contribution grows with its count and falls with the document's length, so these two bound it whatever the corpus adds
later. The index is made where the documents are: nothing is shuffled, and no key gathers rows.

Search: items are taken in tiles of at most `tile_terms` terms, so what every task is sent has a fixed size. For a tile,
1. the terms' document frequencies are summed over the ranges;
2. each item's bound in each block is the sum of its terms' bounds there; the `seeds` best blocks of each item in all ranges
   are scored, and the k-th best score found is the item's first threshold;
3. in each range an item's blocks are sorted by bound and scored from the forward index until the bound drops below the
   threshold, which rises to the k-th best of what the task has found. Tasks hand on k rows an item at most.

Terms, weights and scores are those of `terms`, `weights` and `contribution`, in 64-bit integers. A block whose bound equals
the threshold is scored, so ties are exact.

Defined results: documents with a null text or without a term aren't counted and never found; items with a null text or
without a term find nothing; rows of one item id are one item with the terms of all; repeated documents count each; equal
scores go by id, null ids last; texts of any length are taken whole; extra columns are ignored; an empty side gives no rows.
"""

from __future__ import annotations

import heapq
import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import map_arrow, map_texts

#: Documents of a block.
BLOCK = 32
SCHEMA = "range long, docs long, words long, ids binary, no_id binary, lengths binary, terms binary, df binary, max_first binary, max_block binary, max_count binary, min_length binary, first binary, term binary, count binary"
_KEEP = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters beyond ASCII; only A to Z are lowered."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split() if text else []


def weight(df: int, n: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def contribution(weights, counts, lengths, n: int, total: int):
    """What terms of these weights and counts add to documents of these lengths, in a corpus of n documents and `total` terms."""
    m = 50 + (50 * lengths * n) // total
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 20 * m))


# Index


def _packed(values: np.ndarray) -> bytes:
    """The values in the narrowest unsigned type, whose width comes first."""
    most = int(values.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w))
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


class _Codes(dict):
    def __missing__(self, word):
        code = self[word] = len(self)
        return code


def _range_row(number: int, ids: list, words: list[np.ndarray], codes: _Codes) -> dict:
    """The row of a range: documents with their words as codes."""
    lengths = np.array([len(w) for w in words], np.int64)
    doc = np.repeat(np.arange(len(ids)), lengths)
    names = sorted(codes)
    place = np.empty(len(names), np.int64)
    place[[codes[t] for t in names]] = np.arange(len(names))
    pairs, count = np.unique((doc << 32) | place[np.concatenate(words)], return_counts=True)
    doc, term = pairs >> 32, pairs & 0xFFFFFFFF
    by_term = np.lexsort((doc, term))
    t, b, c, n = term[by_term], doc[by_term] // BLOCK, count[by_term], lengths[doc[by_term]]
    new = np.flatnonzero(np.diff(t, prepend=-1) | np.diff(b, prepend=-1))  # the first posting of each term and block
    return {
        "range": number, "docs": len(ids), "words": int(lengths.sum()), "ids": np.array([i or 0 for i in ids], "<i8").tobytes(),
        "no_id": bytes(i is None for i in ids), "lengths": _packed(lengths), "terms": b" ".join(names),
        "df": _packed(np.bincount(t, minlength=len(names))), "max_first": _packed(np.searchsorted(t[new], np.arange(len(names) + 1))),
        "max_block": _packed(b[new]), "max_count": _packed(np.maximum.reduceat(c, new)), "min_length": _packed(np.minimum.reduceat(n, new)),
        "first": _packed(np.searchsorted(doc, np.arange(len(ids) + 1))), "term": _packed(term), "count": _packed(count),
    }


def build(docs: DataFrame, range_docs: int = 512, range_words: int = 150_000) -> DataFrame:
    """The index of `docs` (doc_id, text), a row for each range of documents; write it and search what was written."""

    def run(frames):
        from pyspark import TaskContext

        numbers = itertools.count(TaskContext.get().partitionId() << 32)
        ids, words, codes, size = [], [], _Codes(), 0

        def row():
            return pd.DataFrame([_range_row(next(numbers), ids, words, codes)])

        for frame in frames:
            for doc, text in zip(frame["doc_id"], frame["text"]):
                own = terms(text)
                if not own:
                    continue
                ids.append(None if pd.isna(doc) else int(doc))
                words.append(np.fromiter(map(codes.__getitem__, own), np.int64, len(own)))
                size += len(own)
                if len(ids) >= range_docs or size >= range_words:
                    yield row()
                    ids, words, codes, size = [], [], _Codes(), 0
        if ids:
            yield row()

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)


def save(index: DataFrame, folder: str) -> DataFrame:
    """Writes the index in small row groups, as its rows are large, and reads it."""
    index.write.option("parquet.block.size", 32 << 20).option("parquet.page.size.row.check.min", 4).parquet(folder)
    return index.sparkSession.read.parquet(folder)


# Search


@dataclass
class Tile:
    """Items and their terms: the terms of item i are places[first[i] : first[i + 1]] of `vocabulary`."""

    ids: list
    vocabulary: dict[bytes, int]
    first: np.ndarray
    places: np.ndarray
    weights: np.ndarray | None = None
    n: int = 0
    total: int = 0

    @staticmethod
    def of(items: list[tuple[int | None, list[bytes]]]) -> Tile:
        vocabulary = _Codes()
        places = [[vocabulary[t] for t in own] for _, own in items]
        first = np.cumsum([0, *map(len, places)])
        return Tile([i for i, _ in items], dict(vocabulary), first, np.array([p for own in places for p in own], np.int64))


class Range:
    """A row of the index as a tile sees it."""

    def __init__(self, row: dict, tile: Tile):
        self.row, self.tile = row, tile
        place = np.array([tile.vocabulary.get(t, -1) for t in row["terms"].split(b" ")], np.int64)
        self.n_terms = len(place)
        self.held = np.flatnonzero(place >= 0)  # terms of the range that items ask for
        self.place = place[self.held]

    def frequencies(self) -> tuple[np.ndarray, np.ndarray]:
        return self.place, _unpacked(self.row["df"])[self.held]

    def bounds(self) -> np.ndarray:
        """The bound of each item (rows) in each block."""
        tile, blocks = self.tile, -(-self.row["docs"] // BLOCK)
        first = _unpacked(self.row["max_first"])
        own = np.concatenate([np.arange(a, b) for a, b in zip(first[self.held], first[self.held + 1])]) if len(self.held) else np.zeros(0, np.int64)
        at = np.repeat(np.arange(len(self.held)), np.diff(first)[self.held])
        self.at_term = np.full(len(tile.vocabulary) + 1, len(self.held))
        self.at_term[self.place] = np.arange(len(self.held))
        each = np.zeros((len(self.held) + 1, blocks), np.int64)
        count, shortest = _unpacked(self.row["max_count"])[own], _unpacked(self.row["min_length"])[own]
        each[at, _unpacked(self.row["max_block"])[own]] = contribution(tile.weights[self.place[at]], count, shortest, tile.n, tile.total)
        return np.add.reduceat(each[self.at_term[tile.places]], tile.first[:-1], axis=0)

    def open(self) -> None:
        """Reads the forward index."""
        self.ids = np.frombuffer(self.row["ids"], "<i8")
        self.no_id = np.frombuffer(self.row["no_id"], np.uint8).astype(bool)
        self.first, self.term, self.count, self.lengths = (_unpacked(self.row[c]) for c in ("first", "term", "count", "lengths"))
        self.near = np.full(self.n_terms, -1)
        self.near[self.held] = np.arange(len(self.held))
        self.blocks: dict[int, np.ndarray] = {}

    def scores(self, item: int, block: int) -> np.ndarray:
        """The item's scores of the block's documents."""
        tile, a, b = self.tile, block * BLOCK, min((block + 1) * BLOCK, self.row["docs"])
        if block not in self.blocks:
            own = slice(self.first[a], self.first[b])
            doc = np.repeat(np.arange(b - a), np.diff(self.first[a : b + 1]))
            at = self.near[self.term[own]]
            doc, count, at = doc[at >= 0], self.count[own][at >= 0], at[at >= 0]
            each = np.zeros((len(self.held) + 1, b - a), np.int64)
            each[at, doc] = contribution(tile.weights[self.place[at]], count, self.lengths[a:b][doc], tile.n, tile.total)
            self.blocks[block] = each
        return self.blocks[block][self.at_term[tile.places[tile.first[item] : tile.first[item + 1]]]].sum(axis=0)


class Best:
    """The k best (score, id) of each item that a task has met; smaller ids first, no id last."""

    def __init__(self, items: int, k: int, least: np.ndarray):
        self.k, self.least, self.rows = k, least.copy(), [[] for _ in range(items)]

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        heap, k = self.rows[item], self.k
        for j in np.flatnonzero((scores > 0) & (scores >= self.least[item])):
            entry = (int(scores[j]), not no_id[j], -int(ids[j]))
            if len(heap) < k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
        if len(heap) == k:
            self.least[item] = max(self.least[item], heap[0][0])

    def batch(self, names: list) -> pa.RecordBatch:
        rows = [(i, names[i], -x if known else None, s) for i, heap in enumerate(self.rows) for s, known, x in heap]
        cols = zip(*rows) if rows else ([], [], [], [])
        kinds = (("item", pa.int32()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64()))
        return pa.RecordBatch.from_pydict({name: pa.array(list(c), kind) for (name, kind), c in zip(kinds, cols)})


FOUND = "item int, item_id long, doc_id long, score long"


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _frequencies(index: DataFrame, tile: Tile) -> dict[int, int]:
    sent = index.sparkSession.sparkContext.broadcast(tile)

    def run(batches):
        total = np.zeros(len(sent.value.vocabulary), np.int64)
        for row in _rows(batches):
            place, df = Range(row, sent.value).frequencies()
            total[place] += df
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"place": pa.array(met, pa.int32()), "df": pa.array(total[met], pa.int64())})

    each = map_arrow(index.select("terms", "df"), run, "place int, df long")
    return {r["place"]: r["df"] for r in each.groupBy("place").agg(F.sum("df").alias("df")).collect()}  # a tile's terms at most


def _seeds(index: DataFrame, sent, seeds: int) -> list:
    """(item, range, block) of the blocks of highest bounds of each item."""

    def run(batches):
        tile, best = sent.value, [[] for _ in sent.value.ids]
        for row in _rows(batches):
            bounds = Range(row, tile).bounds()
            top = np.sort(np.argpartition(-bounds, min(seeds, bounds.shape[1]) - 1, axis=1)[:, :seeds], axis=1)
            for item, blocks in enumerate(top):
                for block in blocks:
                    if bound := int(bounds[item, block]):
                        heapq.heappush(best[item], (bound, row["range"], int(block)))
                        if len(best[item]) > seeds:
                            heapq.heappop(best[item])
        rows = [(i, *x) for i, heap in enumerate(best) for x in heap]
        cols = list(zip(*rows)) if rows else [[]] * 4
        kinds = (("item", pa.int32()), ("bound", pa.int64()), ("range", pa.int64()), ("block", pa.int32()))
        yield pa.RecordBatch.from_pydict({name: pa.array(list(c), kind) for (name, kind), c in zip(kinds, cols)})

    slim = index.select("range", "docs", "terms", "max_first", "max_block", "max_count", "min_length")
    each = map_arrow(slim, run, "item int, bound long, range long, block int")
    top = Window.partitionBy("item").orderBy(F.col("bound").desc(), "range", "block")
    return each.withColumn("n", F.row_number().over(top)).where(F.col("n") <= seeds).select("item", "range", "block").collect()


def _score(index: DataFrame, sent, k: int, least: np.ndarray, only: dict | None) -> DataFrame:
    """The k best documents that each task finds for each item, from the blocks `only` or from all that the bounds leave."""

    def run(batches):
        tile = sent.value
        best = Best(len(tile.ids), k, least)
        for row in _rows(batches):
            held = Range(row, tile)
            bounds = held.bounds()
            if only is None:
                pairs = [(i, np.argsort(-bounds[i], kind="stable")) for i in np.flatnonzero(bounds.max(axis=1) >= np.maximum(best.least, 1))]
            else:
                pairs = [(i, sorted(blocks, key=lambda b: -bounds[i, b])) for i, blocks in only.get(row["range"], {}).items()]
            if pairs:
                held.open()
            for item, blocks in pairs:
                for block in blocks:
                    if bounds[item, block] < max(1, best.least[item]):
                        break
                    a = block * BLOCK
                    best.add(item, held.scores(item, block), held.ids[a : a + BLOCK], held.no_id[a : a + BLOCK])
        yield best.batch(tile.ids)

    return map_arrow(index, run, FOUND)


def _kth(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def tiles(items: DataFrame, tile_terms: int) -> list[Tile]:
    """Items in tiles of bounded size, fetched from the cluster partition by partition."""
    merged = items.groupBy("item_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))
    out, held, size = [], [], 0
    for r in merged.select(F.col("item_id").cast("long"), "text").orderBy("item_id").toLocalIterator():
        own = list(dict.fromkeys(terms(r["text"])))
        if own and held and size + len(own) > tile_terms:
            out.append(Tile.of(held))
            held, size = [], 0
        if own:
            held.append((r["item_id"], own))
            size += len(own)
    return out + [Tile.of(held)] if held else out


def search(index: DataFrame, items: DataFrame, k: int = 50, seeds: int = 4, tile_terms: int = 100_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each item of `items` (item_id, text)."""
    spark: SparkSession = index.sparkSession
    n, total = index.agg(F.sum("docs"), F.sum("words")).head()
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for tile in tiles(items, tile_terms) if n else []:
        df = _frequencies(index, tile)
        tile.n, tile.total = n, total
        tile.weights = np.array([weight(df.get(v, 0), n) for v in range(len(tile.vocabulary))], np.int64)
        sent = spark.sparkContext.broadcast(tile)
        only: dict[int, dict[int, list[int]]] = {}
        for r in _seeds(index, sent, seeds):
            only.setdefault(r["range"], {}).setdefault(r["item"], []).append(r["block"])
        some = spark.createDataFrame([(r,) for r in only], "range long")
        least = np.zeros(len(tile.ids), np.int64)
        seen = _score(index.join(F.broadcast(some), "range", "left_semi"), sent, k, least, only)
        for r in _kth(seen, k).where(F.col("rank") == k).select("item", "score").collect():
            least[r["item"]] = r["score"]
        found = _kth(_score(index, sent, k, least, None), k)
        out = out.unionByName(found.select("item_id", F.col("rank").cast("int"), "doc_id", "score"))
    return out
