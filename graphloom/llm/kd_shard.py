"""Sharding by K-d tree partitioning over metadata, with leaves of nearly equal bytes.

The tree splits a node at the weighted median (for an odd number of leaves the matching weighted quantile) of the
metadata dimension that is widest in it, each dimension measured against its range over all rows, until every leaf
holds one shard's share of the bytes. Split points are found by distributed histograms: a pass adds up the bytes of
256 bins for every open node, the next pass divides the bin in which the quantile falls, until what is left in it is
below the tolerance. Rows that agree in the dimension are told apart by a hash, so a value of any weight can be split.

The driver sees at most 256 bins for each open node. A shard's slots are numbered by prefix sums over hash buckets.

Defined results: a null text has 0 bytes and crc32 0; null lang and source come behind all values, a null id counts as -1;
texts of any length have their whole bytes counted; repeated rows are placed one by one (`nth` numbers them); extra columns are ignored; an empty table gives no rows. The result depends on the rows alone.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, dense_index, fresh, own_columns, row_hash, small

BINS = 256
_SPAN = 1 << 31


def _nodes(rows: DataFrame, names: str, values: list[tuple]) -> DataFrame:
    """A small table of open nodes, at most one row for each shard; passes differ in it alone, so their code is reused."""
    text = ", ".join("(" + ", ".join(f"{x!r}D" if isinstance(x, float) else str(x) for x in v) + ")" for v in values)
    return F.broadcast(rows.sparkSession.sql(f"SELECT * FROM VALUES {text} AS t({names})"))


def kd_leaves(rows: DataFrame, dims: list[str], weight: str, tie: str, leaves: int, tolerance: float = 0.001) -> DataFrame:
    """Adds leaf (0 to leaves - 1). dims: columns of doubles; tie: a column of longs that tells equal rows apart."""
    ranges = [f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)]
    whole = rows.agg(F.sum(weight).alias("w"), *ranges).first()
    rows = rows.withColumn("leaf", F.lit(0).cast("long"))
    if whole["w"] is None:
        return rows
    scale = {d: max(whole[f"max_{d}"] - whole[f"min_{d}"], 1e-300) for d in dims}
    target, open_nodes, columns = whole["w"] / leaves, ({0: leaves} if leaves > 1 else {}), rows.columns
    value = F.coalesce(*[F.when(F.col("_dim") == i, F.col(d)) for i, d in enumerate(dims)])
    unit = F.when(F.col("_hi") > F.col("_lo"), (value - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    place = F.least(F.floor(unit * _SPAN), F.lit(_SPAN - 1)) * F.lit(_SPAN) + F.shiftrightunsigned(F.col(tie), 33)
    while open_nodes:
        stats = rows.join(_nodes(rows, "leaf", [(f"{n}L",) for n in open_nodes]), "leaf").groupBy("leaf").agg(F.sum(weight).alias("w"), *ranges).collect()
        if not stats:
            break
        wide, goal = [], {}
        for s in stats:
            d = max(range(len(dims)), key=lambda i: (s[f"max_{dims[i]}"] - s[f"min_{dims[i]}"]) / scale[dims[i]])
            wide.append((f"{s['leaf']}L", d, float(s[f"min_{dims[d]}"]), float(s[f"max_{dims[d]}"])))
            goal[s["leaf"]] = s["w"] * (open_nodes[s["leaf"]] // 2) / open_nodes[s["leaf"]]
        keyed = cut(rows.join(_nodes(rows, "leaf, _dim, _lo, _hi", wide), "leaf", "left").select(*columns, place.alias("_place")))
        start, width, before, split = dict.fromkeys(goal, 0), dict.fromkeys(goal, -(-_SPAN * _SPAN // BINS)), dict.fromkeys(goal, 0), {}
        while len(split) < len(goal):
            todo = [n for n in goal if n not in split]
            own = keyed.join(_nodes(rows, "leaf, _start, _width", [(f"{n}L", f"{start[n]}L", f"{width[n]}L") for n in todo]), "leaf")
            own = own.withColumn("_bin", F.floor((F.col("_place") - F.col("_start")) / F.col("_width"))).where((F.col("_bin") >= 0) & (F.col("_bin") < BINS))
            found = own.groupBy("leaf", "_bin").agg(F.sum(weight).alias("w"), F.min("_place").alias("first"), F.max("_place").alias("last")).collect()
            for n in todo:
                for b in sorted((x for x in found if x["leaf"] == n), key=lambda x: x["_bin"]):
                    if before[n] + b["w"] >= goal[n]:
                        break
                    before[n] += b["w"]
                if b["w"] <= tolerance * target or b["first"] == b["last"]:
                    near = goal[n] - before[n] <= before[n] + b["w"] - goal[n]
                    split[n] = b["first"] if near else b["last"] + 1
                else:
                    start[n], width[n] = b["first"], (b["last"] - b["first"]) // BINS + 1
        right = {n: n + open_nodes[n] // 2 for n in split}
        cuts = _nodes(rows, "leaf, _split, _right", [(f"{n}L", f"{split[n]}L", f"{right[n]}L") for n in split])
        moved = F.when(F.col("_place") >= F.col("_split"), F.col("_right")).otherwise(F.col("leaf"))
        rows = cut(keyed.join(cuts, "leaf", "left").select(*[moved.alias(c) if c == "leaf" else F.col(c) for c in columns]))
        parts = {n: open_nodes[n] // 2 for n in split} | {right[n]: open_nodes[n] - open_nodes[n] // 2 for n in split}
        open_nodes = {n: k for n, k in parts.items() if k > 1}
    return rows


def shards(docs: DataFrame, n_shards: int = 40, slot_bucket: int = 4000) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, lang, source, nth) for every row; the law is `bytes`."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long"), "lang", "source",
        (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    counted = cut(slim.groupBy("doc_id", "lang", "source", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_n")))
    for c in ("lang", "source"):
        index = dense_index(counted, c, f"_{c}").withColumnRenamed(c, "_value")
        counted = counted.join(index, F.col(c).eqNullSafe(F.col("_value"))).drop("_value")
    nth = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_nth")
    each = counted.select("doc_id", "lang", "source", "size", "text_crc32", F.col("_lang").cast("double"), F.col("_source").cast("double"), nth)
    each = each.withColumn("_length", F.log2("size")).withColumn("_id", F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.0)))
    rows = cut(each.withColumn("_tie", F.xxhash64("text_crc32", "doc_id", "_nth")))
    placed = kd_leaves(rows, ["_source", "_lang", "_length", "_id"], "size", "_tie", n_shards)
    total = placed.count()
    buckets = math.ceil(total / n_shards / slot_bucket) + 7
    placed = placed.withColumn("_bucket", F.pmod(F.xxhash64("_tie"), F.lit(buckets)))
    before = Window.partitionBy("leaf").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("leaf", "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    order = Window.partitionBy("leaf", "_bucket").orderBy("_tie", "doc_id", "_nth")
    out = placed.withColumn("_row", F.row_number().over(order)).join(base, ["leaf", "_bucket"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("leaf").cast("int").alias("shard"),
        (F.col("_base") + F.col("_row") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "lang", "source", F.col("_nth").alias("nth"),
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Writes each row of docs once under path/shard=N; several files a shard, so that no task writes a whole shard.

    Rows that agree in id, language, source and text are numbered within the input's partitions, shifted by the counts of the
    partitions before, and the n-th takes the n-th place. docs is a file scan or a checkpoint; a column shard of its is replaced.
    """
    row, part, base, nth, key = fresh(docs, "row", "part", "base", "nth_row", "key_")
    of_key = lambda crc: F.struct("doc_id", "lang", "source", crc)
    named = docs.withColumn(key, of_key(F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"))).withColumn(row, row_hash(docs))
    often = small(cut(placed.where("nth > 1").select(of_key(F.col("text_crc32").alias("crc")).alias(key)).distinct()))
    alone = named.join(often, key, "left_anti").withColumn(nth, F.lit(1).cast("long"))
    again = named.join(often, key, "left_semi").withColumn(part, F.spark_partition_id())
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = again.groupBy(key, part).agg(F.count(F.lit(1)).alias("_n")).select(key, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(base))
    number = F.row_number().over(Window.partitionBy(key, part).orderBy(row))
    again = again.withColumn(nth, number).join(sums, [key, part]).withColumn(nth, F.col(nth) + F.col(base)).drop(part, base)
    places = placed.select(of_key(F.col("text_crc32").alias("crc")).alias(key), F.col("nth").alias(nth), F.col("shard").alias("_to"))
    met = alone.unionByName(again).join(places, [key, nth])
    met.select(*own_columns(docs.drop("shard")), F.col("_to").alias("shard")).write.partitionBy("shard").mode("overwrite").parquet(path)
