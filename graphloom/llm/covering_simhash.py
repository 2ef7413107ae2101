"""SimHash fingerprints linked by covering locality-sensitive hashing.

Fingerprint: ASCII capitals are lowered, words are runs of anything but ASCII white space, shingles are runs of
`shingle_words` words joined by one space, repeats included (fewer words: the whole sequence; none: fingerprint 0).
A bit is 1 if it is set in over half of the shingles' XXH64 values (seed 42).

Covering: with radius r, bit i carries one of the 2^(r+1)-1 non-zero vectors of r+1 bits, dealt in turn, and table v
keeps the bits whose vector has an odd product with v. For any r differing bits r equations in r+1
unknowns leave a non-zero v whose mask avoids all of them, so every pair within the radius agrees in some table.

Links inside the buckets of the tables, never as all pairs. A bucket of up to `SMALL_BUCKET` fingerprints is compared
by one vectorised step and leaves a spanning set of links. In a larger bucket each fingerprint sends itself to the
values that its bits outside the mask give with at most radius / 2 of them turned: two of the bucket meet at such a
value exactly if they differ in at most radius bits (which is even), and all that meet are linked to the smallest. So a
bucket of any size costs a linear number of rows, and no task holds it.
Components come from minimum labels with pointer jumping; each round is checkpointed, and keys with many rows (a node
with many links, the label of a large component) are dealt to several tasks.

Defined results: null and empty texts have fingerprint 0, linked like any other; a null id is a document that never
lends its id to a component and gets the smallest other id (null if there is none); repeated rows stay as they are;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Spread, cut, gathered, map_texts, sized_anew, steady

#: Buckets with more fingerprints than this are not compared in one step.
SMALL_BUCKET = 256

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: str | None, shingle_words: int) -> np.ndarray:
    """XXH64 of every shingle of the text, repeats included."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle_words, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist())], "<u8")


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    return majority(shingle_hashes(text, shingle_words))


def majority(h: np.ndarray) -> int:
    """The fingerprint of shingles by their hashes."""
    if not len(h):
        return 0
    lanes = h.view(np.uint8).reshape(-1, 8)
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 32_768):
        bits = np.unpackbits(lanes[at : at + 32_768], axis=1, bitorder="little")
        for part in range(0, len(bits), 255):
            total += bits[part : part + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(frames):
        for pdf in frames:
            fp = np.array([fingerprint(t, shingle_words) for t in pdf["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fp})

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def covering_masks(radius: int = 2, bits: int = 64) -> list[int]:
    """One mask for each table, as signed longs."""
    n = 2 ** (radius + 1) - 1
    masks = []
    for v in range(1, n + 1):
        m = sum(1 << i for i in range(bits) if bin((i % n + 1) & v).count("1") % 2)
        masks.append(_signed(m))
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _turned(mask: int, most: int) -> list[int]:
    """All ways to turn up to `most` of the bits that the mask leaves out, as signed longs."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [_signed(sum(1 << i for i in c)) for n in range(most + 1) for c in itertools.combinations(free, n)]


def spanning_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the values that join exactly those within the radius or connected by such: one less than the values
    of each group, each to the smallest value of the group."""
    fps = np.unique(fps.astype(np.int64))
    label = np.arange(len(fps))
    near = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= radius
    while True:
        new = np.where(near, label[None, :], len(fps)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(fps))
    return fps[own], fps[label[own]]


def fingerprint_links(distinct: DataFrame, radius: int = 2, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """(fp, hub): links between the distinct fingerprints that connect exactly those within the (even) radius."""
    masks = covering_masks(radius)
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("slot", "mask"))
    keyed = keyed.select("slot", F.col("fp").bitwiseAND(F.col("mask")).alias("kept"), "fp")
    sizes = keyed.groupBy("slot", "kept").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = gathered(keyed.join(sizes, ["slot", "kept"]))

    def compare(frames):
        for pdf in frames:
            pairs = np.array([f for f in pdf["fps"] if len(f) == 2], np.int64).reshape(-1, 2)
            near = pairs[np.bitwise_count((pairs[:, 0] ^ pairs[:, 1]).view(np.uint64)) <= radius]
            found = [(near.max(axis=1, initial=-(1 << 63)), near.min(axis=1, initial=(1 << 63) - 1))]
            found += [spanning_links(np.asarray(f), radius) for f in pdf["fps"] if len(f) > 2]
            fp, hub = (np.concatenate(x) for x in zip(*found))
            yield pd.DataFrame({"fp": fp, "hub": hub})

    few = shared.where(F.col("n") <= small_bucket).groupBy("slot", "kept").agg(F.collect_list("fp").alias("fps"))
    links = few.select("fps").mapInPandas(compare, "fp long, hub long")
    if shared.where(F.col("n") > small_bucket).limit(1).count():
        ways = F.array(*[F.array(*[F.lit(w).cast("long") for w in _turned(m, radius // 2)]) for m in masks])
        many = shared.where(F.col("n") > small_bucket).select("slot", "kept", "fp", F.explode(F.get(ways, F.col("slot"))).alias("way"))
        # the slot and the bits outside the mask with some of them turned; the kept bits are those of the bucket
        meet = many.select(F.struct("slot", F.col("fp").bitwiseXOR(F.col("way")).alias("value")).alias("at"), "fp")
        hubs = meet.groupBy("at").agg(F.min("fp").alias("hub"), F.max("fp").alias("hi")).where("hub <> hi").select("at", "hub")
        links = links.unionByName(Spread(meet, "at").join(hubs).where("fp <> hub").select("fp", "hub"))
    return links.distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): the smallest node reachable from each node that has an edge."""
    both = sized_anew(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))))
    with steady(edges.sparkSession):
        labels = gathered(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).select(F.col("u").alias("node"), "label"))
        links = Spread(both, "v")
        while True:
            seen = links.join(labels.select(F.col("node").alias("v"), "label")).groupBy("u").agg(F.min("label").alias("near"))
            lower = labels.join(seen.withColumnRenamed("u", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
            lower = gathered(lower)
            up = lower.select(F.col("node").alias("label"), F.col("label").alias("jump"))
            jumped = sized_anew(Spread(lower, "label").join(up).select("node", "was", F.least("label", "jump").alias("label")))
            labels = jumped.select("node", "label")
            if jumped.where("was <> label").isEmpty():
                return labels


def near_duplicates(docs: DataFrame, shingle_words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs."""
    fps = cut(fingerprints(docs, shingle_words))
    first = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    labels = components(fingerprint_links(first.select("fp"), radius), "fp", "hub")
    linked = labels.join(first, labels["node"] == first["fp"]).select("fp", "label", "first_id")
    ids = linked.groupBy("label").agg(F.min("first_id").alias("component_first"))
    wide = Spread(linked, "label").join(ids).select("fp", "component_first")
    # written out, so that the last join has two plain sides and a hot fingerprint's side of it can be split
    of = cut(first.join(wide, "fp", "left").select("fp", F.coalesce("component_first", "first_id").alias("component_id")))
    return fps.join(of, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
