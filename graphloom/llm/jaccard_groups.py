"""Groups of documents whose sets of word shingles have a Jaccard similarity of at least `percent` per cent, exactly.

Shingles are those of covering_simhash (`shingle_words` words, ASCII capitals lowered), known by their XXH64 values.

Candidates by fingerprints: the sets' covering SimHash fingerprints (repeats included) are linked as covering_simhash links
them, within 2 bits, and the links compared on whole sets. Fingerprints of sets that are similar at 80 per cent differ in up to
14 bits, though, so what these links leave open is completed by prefixes.

Candidates by prefixes: put the shingles of a set of m in one order for all sets; two sets of similarity t share one of
the first m - ceil(t m) + 1 of each, so no pair is missed, whatever the order is. Bounds on the places of the first shared
shingle and on sketches then reject pairs that cannot be similar; the rest are compared on their whole sets. Shingles that
a sample of the documents shows to be common come last, so that common passages make few candidates; the sample touches
the cost, never the result.

Links: equal sets are one node. In each round every set of a bucket (the sets with one prefix shingle) is compared with
one set of the bucket, and the components of the links found label the sets: first with one whose place in its prefix
is early, then with one of its own size, then with any, and so on in turn. Sets that have the label of the chosen set need
no comparison, and buckets with one label are done, so a large group of near copies costs a linear number of rows. Once a
round finds a link for at most one pair in 4, or after `ROUNDS` rounds, the pairs of unlike labels that are left in the
buckets are compared one by one, so no link is missed. The number of these is the square of a bucket's unlike sets: rows of
two ids each, of which sketches reject nearly all before a set is moved. A bucket holds many unlike sets only where they share
a shingle that the sample didn't show to be common.

Defined results: texts without words have the empty set and are one group; repeated rows stay as they are; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .covering_simhash import components, fingerprint_links, majority, shingle_hashes
from .shared import Spread, collected, cut, gathered, map_texts, row_hash, sized_anew, small, steady, tidy

#: The sample that finds common shingles: one document in SAMPLE, the shingles of at least COMMON sets, HOT at most.
SAMPLE, COMMON, HOT = 32, 3, 200_000
#: Rounds before the rest is compared one by one; it doesn't touch the result.
ROUNDS = 8


def shingle_set(text: str | None, shingle_words: int = 5) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle_words))


def _common(docs: DataFrame, row: Column, shingle_words: int) -> np.ndarray:
    def run(frames):
        for pdf in frames:
            sets = [shingle_set(t, shingle_words).view(np.int64) for t in pdf["text"]]
            yield pd.DataFrame({"h": sets, "node": [_node(s) for s in sets]})

    some = docs.where(F.pmod(row, F.lit(SAMPLE)) == 0).select("text")
    each = map_texts(some, run, "h array<long>, node long").dropDuplicates(["node"]).select(F.explode("h").alias("h"))
    often = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    top = often.orderBy(F.col("n").desc(), "h").limit(HOT).select("h")
    return np.sort(collected(top)["h"].to_numpy(np.int64).view(np.uint64))


def _node(shingles: np.ndarray) -> int:
    """The name of a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 42)).view(np.int64)) if len(shingles) else 0


def _prefix(shingles: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    n = len(shingles)
    if len(common) and n:
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        last = common[at] == shingles
        shingles = np.concatenate([shingles[~last], shingles[last]])
    return shingles[: n + (-percent * n) // 100 + 1]


def _sketch(shingles: np.ndarray) -> bytes:
    """Parities of the numbers of shingles in 2,048 classes: sketches differ in no more bits than their sets in shingles."""
    return np.packbits(np.bincount((shingles & np.uint64(2047)).astype(np.int64), minlength=2048) & 1).tobytes()


def measured(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(row, doc_id, node, size, sketch, fp, prefix) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(_common(docs, row_hash(docs), shingle_words))

    def run(frames):
        for pdf in frames:
            each = [shingle_hashes(t, shingle_words) for t in pdf["text"]]
            fps, sets = np.array([majority(h) for h in each], np.uint64).view(np.int64), [np.unique(h) for h in each]
            yield pd.DataFrame({
                "fp": fps, "row": pdf["row"], "doc_id": pdf["doc_id"], "node": [_node(s) for s in sets], "size": [len(s) for s in sets],
                "sketch": [_sketch(s) for s in sets], "prefix": [_prefix(s, shared.value, percent).view(np.int64) for s in sets],
            })

    slim = docs.select(row_hash(docs).alias("row"), F.col("doc_id").cast("long"), "text")
    return map_texts(slim, run, "row long, doc_id long, node long, size long, sketch binary, fp long, prefix array<long>")


def _similar(docs: DataFrame, rows: DataFrame, pairs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar. Sketches reject most others before any set is moved."""
    with steady(docs.sparkSession):
        return _compared(docs, rows, pairs, shingle_words, percent)


def _compared(docs: DataFrame, rows: DataFrame, pairs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    nodes = gathered(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    # only rows of the pairs' sets are brought together
    own = rows.select("node", "row", "size", "sketch").join(small(nodes), "node", "left_semi")
    known = gathered(own.groupBy("node").agg(F.min("row").alias("row"), F.max("size").alias("size"), F.max("sketch").alias("sketch")))
    known = small(known, 100_000)
    tidy(docs.sparkSession)
    side = lambda c: known.select(F.col("node").alias(c), F.col("size").alias(f"m{c}"), F.col("sketch").alias(f"s{c}"))

    def likely(frames):
        for pdf in frames:
            x, y = (np.frombuffer(b"".join(pdf[c]), np.uint64).reshape(-1, 32) for c in ("sa", "sb"))
            apart, total = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64), pdf["ma"] + pdf["mb"]
            yield pdf.loc[(100 + percent) * apart <= (100 - percent) * total, ["a", "b"]]

    pairs = gathered(pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(likely, "a long, b long"))
    tidy(docs.sparkSession)
    if pairs.isEmpty():  # no text needs to be read
        return pairs
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    owner = gathered(known.join(nodes, "node", "left_semi").select("row", "node"))
    texts = docs.select(row_hash(docs).alias("row"), "text").join(small(owner), "row").select("node", "text")

    def run(frames):
        for pdf in frames:
            sets = [shingle_set(t, shingle_words).view(np.int64) for t in pdf["text"]]
            yield pd.DataFrame({"node": pdf["node"], "shingles": sets})

    # rows that are equal in all columns bring their set more than once, which repeats pairs
    sets = map_texts(texts, run, "node long, shingles array<long>")
    # a set that is the middle of many pairs is dealt to several tasks on either side
    one = Spread(pairs, "a")
    other = Spread(one.many, "b")
    one.many = other.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")))
    both = one.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")))
    common = F.size(F.array_intersect("x", "y")).cast("long")
    return gathered(both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b").distinct())


def _covered(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints are equal or linked: each set with the smallest of its fingerprint, and those
    with each other along the links."""
    sets = gathered(rows.where("size > 0").groupBy("node").agg(F.min("fp").alias("fp")))  # equal sets may differ in repeats
    first = gathered(sets.groupBy("fp").agg(F.min("node").alias("first")))
    links = gathered(fingerprint_links(first.select("fp")))
    end = lambda fp, c: first.select(F.col("fp").alias(fp), F.col("first").alias(c))
    near = links.join(end("fp", "x"), "fp").join(end("hub", "y"), "hub").select("x", "y")
    same = Spread(sets, "fp").join(first).where("node <> first").select(F.col("node").alias("x"), F.col("first").alias("y"))
    return gathered(near.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def _relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, label) after more links (a, b): the components of the labels that they join."""
    if labels is None:
        return components(links, "a", "b")
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    with steady(links.sparkSession):
        joined = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("la", "a").alias("x"), F.coalesce("lb", "b").alias("y"))
        joined = gathered(joined)
        merged = components(joined.where("x <> y").select("x", "y").distinct(), "x", "y")
        new = joined.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti")
        known = gathered(labels.unionByName(new.withColumn("label", F.col("node"))))
        to = merged.select(F.col("node").alias("label"), F.col("label").alias("new"))
        return sized_anew(Spread(known, "label").join(to, "left").select("node", F.coalesce("new", "label").alias("label")))


def groups(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(row, doc_id, group) for every row of docs: its hash, its id and the name of its group."""
    spark = docs.sparkSession
    tidy(spark)
    rows = cut(measured(docs, shingle_words, percent))
    keyed = rows.select("node", "size", F.posexplode("prefix").alias("pos", "h"))
    shared = gathered(keyed.groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("h"))
    tidy(spark)
    members = gathered(keyed.join(small(shared), "h").distinct())
    tidy(spark)
    # the first shingle that two similar sets share leaves room for enough others behind it in both
    near = (100 + percent) * F.least(F.col("size") - F.col("pos"), F.col("o_size") - F.col("o_pos")) >= percent * (F.col("size") + F.col("o_size"))
    kept = ("node", "size", "pos", "label")
    labels, compared, last = None, _covered(rows), False
    if not compared.isEmpty():
        links = _similar(docs, rows, compared, shingle_words, percent)
        if not links.isEmpty():
            labels = _relabelled(None, links)
    tidy(spark)
    for turn in itertools.count():
        now = members.withColumn("label", F.col("node")) if labels is None else members.join(small(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
        bounds = F.min("label").alias("lo"), F.max("label").alias("hi")
        if last:
            now = gathered(now.join(small(gathered(now.groupBy("h").agg(*bounds).where("lo <> hi").select("h"))), "h"))
            tidy(spark)
            met = now.join(now.select("h", *[F.col(c).alias(f"o_{c}") for c in kept]), "h").where("node < o_node")
        else:
            # the set with the fewest own shingles before the bucket's is nearest to the middle of a group of near copies
            place = F.struct(F.lit(0) if turn else F.col("pos"), F.xxhash64("h", "node", F.lit(turn)))
            now = now.withColumn("class", F.col("size") if turn % 2 else F.lit(0).cast("long"))
            hubs = now.groupBy("h", "class").agg(*bounds, F.min_by(F.struct(*kept), place).alias("o")).where("lo <> hi")
            hubs = gathered(hubs.select("h", "class", *[F.col(f"o.{c}").alias(f"o_{c}") for c in kept]))
            if not turn % 2 and hubs.isEmpty():  # every bucket has one label
                break
            met = now.join(small(hubs), ["h", "class"])
        pairs = met.where((F.col("label") != F.col("o_label")) & near).select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b")).distinct()
        pairs = gathered(pairs.join(small(compared), ["a", "b"], "left_anti"))
        tidy(spark)
        # a round that has nothing to compare costs no further jobs
        asked = pairs.count()
        links = _similar(docs, rows, pairs, shingle_words, percent) if asked else pairs
        found = links.count() if asked else 0
        tidy(spark)
        if found:
            labels = _relabelled(labels, links)
            tidy(spark)
        if last:
            break
        compared = compared.unionByName(pairs) if asked else compared
        last = 4 * found <= asked or turn >= ROUNDS
    out = rows.select("row", "doc_id", "node")
    if labels is None:
        return out.select("row", "doc_id", F.col("node").alias("group"))
    return out.join(small(labels), "node", "left").select("row", "doc_id", F.coalesce("label", "node").alias("group"))
