"""Exact top-k search by tiled matrix products.

Vectors are turned into floor(scale * x) integers and packed into tiles: query tiles and candidate tiles of bounded
bytes, each a row with the ids and the matrix. Query blocks and candidate shards form a grid; a tile of either side
is copied along its own axis of it only, so each pair of tiles meets once and no task holds all queries or all
candidates. A meeting is one matrix product, from which each query keeps its k best; those partial lists are merged
in a tree: per query and group of shards, then per query.

Products are exact: in floating point while dimension * (largest component)^2 stays below 2^53, else with integers of
any length (scores beyond a long are clamped to it). Vectors of different lengths are not compared.

Defined results: vectors that are null or hold null, NaN or infinite components take no part, nor do those with a component
that is beyond a double once scaled, nor rows without an id; a query is not compared with rows of its own id; each query row of an id that repeats has its lists merged, so a
repeated id gets the k best (score, vec_id) pairs over its rows; repeated candidates each count; ties go to the
smaller id; extra columns are ignored; an empty side gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

TILE = "shard int, dim int, n int, ids binary, matrix binary"
_TOP = 2**63 - 1


def _tiles(vectors: DataFrame, shards: int, scale: float, tile_rows: int) -> DataFrame:
    """Tiles of the vectors; a row's shard follows from its place among the input's partitions."""

    def run(frames):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[int, tuple[list, list]] = {}
        made = 0

        def tile(dim):
            nonlocal made
            ids, rows = held.pop(dim)
            made += 1
            return pd.DataFrame({"shard": [(part * 7919 + made) % shards], "dim": [dim], "n": [len(ids)], "ids": [np.array(ids, "<i8").tobytes()], "matrix": [np.array(rows, "<f8").tobytes()]})

        for pdf in frames:
            for i, v in zip(pdf["vec_id"], pdf["embedding"]):
                v = np.floor(scale * np.asarray(v, np.float64))
                ids, rows = held.setdefault(len(v), ([], []))
                ids.append(int(i))
                rows.append(v)
                if len(ids) >= max(1, min(tile_rows, 2_000_000 // (8 * len(v) + 8))):
                    yield tile(len(v))
        for dim in list(held):
            yield tile(dim)

    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double") * scale) == float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    return good.select(F.col("vec_id").cast("long"), "embedding").mapInPandas(run, TILE)


def _products(k: int):
    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                q_ids, c_ids = np.frombuffer(r.q_ids, "<i8"), np.frombuffer(r.ids, "<i8")
                q = np.frombuffer(r.q_matrix, "<f8").reshape(r.q_n, r.dim)
                c = np.frombuffer(r.matrix, "<f8").reshape(r.n, r.dim)
                largest = max(np.abs(q).max(initial=0), np.abs(c).max(initial=0))
                if r.dim * largest * largest < 2**53:
                    scores = np.rint(q @ c.T).astype(np.int64)
                else:
                    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
                    scores = np.array([[max(-_TOP - 1, min(_TOP, x)) for x in row] for row in whole(q) @ whole(c).T], np.int64).reshape(r.q_n, r.n)
                by_id = np.argsort(c_ids, kind="stable")
                scores, c_ids = scores[:, by_id], c_ids[by_id]
                out = []
                for own, row in zip(q_ids, scores):
                    other = np.flatnonzero(c_ids != own)
                    row = row[other]
                    if len(row) > k:
                        least = np.partition(row, len(row) - k)[len(row) - k]
                        above = np.flatnonzero(row > least)
                        other, row = (lambda at: (other[at], row[at]))(np.concatenate([above, np.flatnonzero(row == least)[: k - len(above)]]))
                    out.append((np.full(len(row), own), c_ids[other], row))
                if out:
                    ids, vec, score = (np.concatenate(x) for x in zip(*out))
                    yield pd.DataFrame({"query_id": ids, "vec_id": vec, "score": score, "shard": np.full(len(ids), r.shard, np.int32)})

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, scale: float = 1024.0, tile_rows: int = 4096, shards: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of highest integer inner product for each query."""
    spark = queries.sparkSession
    shards = shards or 2 * spark.sparkContext.defaultParallelism
    q = cut(_tiles(queries, 1 << 20, scale, 256).withColumnsRenamed({"shard": "block", "n": "q_n", "ids": "q_ids", "matrix": "q_matrix"}))
    blocks = max(1, math.ceil(q.count() / 8))
    q = q.withColumn("block", F.pmod("block", F.lit(blocks)).cast("int"))
    c = _tiles(candidates, shards, scale, tile_rows)
    # along its axis, a tile goes to each cell of the grid
    q = q.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    c = c.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = c.join(q, ["block", "shard", "dim"]).select("shard", "dim", "n", "ids", "matrix", "q_n", "q_ids", "q_matrix")
    lists = met.mapInPandas(_products(k), "query_id long, vec_id long, score long, shard int")
    best = lambda by: Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
    fan = max(2, math.isqrt(shards))
    merged = lists.withColumn("group", (F.col("shard") / fan).cast("int")).withColumn("rank", F.row_number().over(best(["query_id", "group"]))).where(F.col("rank") <= k)
    merged = merged.select("query_id", "vec_id", "score").withColumn("rank", F.row_number().over(best(["query_id"]))).where(F.col("rank") <= k)
    return merged.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
