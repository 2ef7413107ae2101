"""Mixing sources to target weights by entropy balancing.

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share 150 % of all sizes. A source's target
stops at twice its size; the excess is shared anew by weight until no target is above.

Each document gets a rate (expected copies) r = min(2, exp(x * size / mean size)): the rates nearest to one copy each
in relative entropy, not above 2, whose sizes add up to the source's target. x solves the convex dual of that token
constraint by Newton iterations, bracketed by bisection where the cap bends the dual. The sums of an iteration are
taken over counted (source, size) pairs, so a hot source is added up in parts on all tasks.

Rates are rounded into whole copies by error diffusion: within buckets of a source, from the largest document to the
smallest, a document takes the number of copies next to its rate that keeps the running sum nearest to the rates'.

Defined results: a null text has size 0; documents of size 0 are taken once if the source's rate is below the cap
(0 words either way); a null source is a source of its own; repeated rows are documents of their own; extra columns
are ignored by `mix` and kept by `apply_mix`; texts of any length are counted whole; an empty table gives no rows. The result depends on the rows alone.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, dense_index, fresh, gathered, own_columns, row_hash, shuffle_width, small

CAP = 2.0


def targets(sources: DataFrame, weights=(5, 2, 1), budget: float = 1.5) -> DataFrame:
    """Adds target to (source_no, source_size, ...) rows, one for each source."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    own = gathered(sources.withColumn("_w", weight).withColumn("_cap", CAP * F.col("source_size")))
    total = own.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    level, capped = -1.0, F.lit(False)
    while True:  # the level only rises, and each round caps another source
        s = own.agg(F.sum(F.when(capped, F.col("_cap"))).alias("fixed"), F.sum(F.when(~capped, F.col("_w"))).alias("open")).first()
        new = (budget * total - (s["fixed"] or 0.0)) / s["open"] if s["open"] else level
        if new <= level:
            break
        level = new
        capped = F.col("_cap") <= F.col("_w") * level
    return own.withColumn("target", F.when(capped, F.col("_cap")).otherwise(F.col("_w") * level)).drop("_w", "_cap")


def tilts(sizes: DataFrame, goals: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(source_no, source_size, target, mean, tilt) from (source_no, size, n) and the goals.

    A source at its cap has an infinite tilt, which stands for rate 2. A source ends when its sum is within the tolerance of
    its target or its bracket is as narrow as doubles are; every third step halves the bracket, so this always comes.
    """
    mean = sizes.groupBy("source_no").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    at_cap = F.col("target") >= CAP * F.col("source_size") * (1 - 1e-12)
    # the tilt of the largest document at the cap bounds the bracket from above once a step has passed it
    start = (
        goals.join(mean, "source_no")
        .withColumn("done", at_cap | (F.col("source_size") == 0))
        .withColumn("tilt", F.when(at_cap, float("inf")).otherwise(0.0))
        .withColumn("lo", F.lit(-1e4))
        .withColumn("hi", F.lit(1e6))
    )
    state, fixed = gathered(start), goals.columns
    for turn in itertools.count(1):
        if state.where(~F.col("done")).limit(1).count() == 0:
            break
        z = F.col("tilt") * F.col("size") / F.col("mean")
        below = z < float(np.log(CAP))
        rate = F.when(below, F.exp(z)).otherwise(CAP)
        own = sizes.join(state.where(~F.col("done")).select("source_no", "tilt", "mean"), "source_no")
        sums = own.groupBy("source_no").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("got"),
            F.sum(F.when(below, F.col("n") * F.col("size") * rate * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"),
        )
        gap = F.col("got") - F.col("target")
        lo = F.when(gap < 0, F.col("tilt")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("tilt")).otherwise(F.col("hi"))
        step = F.col("tilt") - gap / F.col("slope")
        middle = F.when(F.col("_hi") >= 1e6, F.greatest(F.col("tilt") * 2, F.lit(1.0))).when(F.col("_lo") <= -1e4, F.least(F.col("tilt") * 2, F.lit(-1.0))).otherwise((F.col("_lo") + F.col("_hi")) / 2)
        joined = state.join(sums, "source_no", "left").withColumn("_lo", lo).withColumn("_hi", hi)
        narrow = F.col("_hi") - F.col("_lo") <= 1e-14 * F.greatest(F.abs("_lo"), F.abs("_hi"))
        done = F.col("done") | (F.abs(gap) <= tolerance * F.col("target")) | F.coalesce(narrow, F.lit(False))
        bracketed = (F.col("_lo") > -1e4) & (F.col("_hi") < 1e6)
        inside = (F.col("slope") > 0) & (step > F.col("_lo")) & (step < F.col("_hi")) & (F.lit(turn % 3 != 0) | ~bracketed)
        tilt = F.when(done, F.col("tilt")).when(inside, step).otherwise(middle)
        state = gathered(joined.select(*fixed, "mean", done.alias("done"), tilt.alias("tilt"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi")))
    return state.select(*fixed, "mean", "tilt")


def _round(frames):
    """Copies by error diffusion over rows sorted by (source, bucket, size descending, id)."""
    key, owed = None, 0.0
    for pdf in frames:
        rate, size = pdf["rate"].to_numpy(), pdf["size"].to_numpy()
        copies = np.zeros(len(pdf), np.int64)
        keys = list(zip(pdf["source_no"], pdf["bucket"]))
        for i, k in enumerate(keys):
            if k != key:
                key, owed = k, 0.0
            r, s = rate[i], size[i]
            low = int(r)
            more = r - low > 0 and owed + (r - low) * s >= 0.5 * s
            copies[i] = low + more
            owed += (r - copies[i]) * s
        yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "size": size, "source_no": pdf["source_no"], "nth": pdf["nth"], "copies": copies})


def rates(docs: DataFrame, weights=(5, 2, 1), budget: float = 1.5, bucket_docs: int = 1000):
    """Copies of every row and the sources: (doc_id, size, source_no, nth, copies), (source, source_no, source_size, target)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    slim = gathered(docs.select(F.col("doc_id").cast("long"), "source", size.alias("size")))
    per_source = gathered(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")))
    index = dense_index(per_source, "source", "source_no")
    sources = gathered(targets(_with_source(per_source, index), weights, budget))
    numbered = _with_source(slim, small(sources.select("source", "source_no")))
    sizes = gathered(numbered.groupBy("source_no", "size").agg(F.count(F.lit(1)).alias("n")))
    solved = gathered(tilts(sizes, sources.select("source_no", "source_size", "target", "docs")))
    # equal rows are counted first, so that repeats of one document spread over the buckets of their source
    rate = F.when(F.col("tilt") == float("inf"), CAP).otherwise(F.least(F.lit(CAP), F.exp(F.col("tilt") * F.col("size") / F.col("mean"))))
    nth = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth")
    each = numbered.groupBy("doc_id", "source_no", "size").agg(F.count(F.lit(1)).alias("n")).select("doc_id", "source_no", "size", nth)
    rated = each.join(solved.select("source_no", "tilt", "mean", "docs"), "source_no").withColumn("rate", F.coalesce(rate, F.lit(1.0)))
    bucket = F.pmod(F.xxhash64("doc_id", "nth"), F.ceil(F.col("docs") / bucket_docs))
    dealt = rated.withColumn("bucket", bucket).repartition(shuffle_width(docs.sparkSession), "source_no", "bucket")
    order = [F.col("source_no"), F.col("bucket"), F.col("size").desc(), F.col("doc_id"), F.col("nth")]
    copies = dealt.sortWithinPartitions(*order).mapInPandas(_round, "doc_id long, size long, source_no long, nth long, copies long")
    return copies, sources


def _with_source(slim: DataFrame, sources: DataFrame) -> DataFrame:
    other = sources.withColumnRenamed("source", "_source")
    return slim.join(other, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def mix(docs: DataFrame, weights=(5, 2, 1), budget: float = 1.5) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row."""
    copies, sources = rates(docs, weights, budget)
    out = copies.join(sources.select("source_no", "source_size", "target"), "source_no")
    return out.select("doc_id", "size", "source_size", F.col("target").cast("double"), (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, weights=(5, 2, 1), budget: float = 1.5) -> DataFrame:
    """docs with every row repeated as often as the mix takes it.

    Rows of equal (id, source, size) share their copies evenly; a remainder goes to them in the order of a hash over their columns.
    """
    copies, sources = rates(docs, weights, budget)
    doc, source, size, total, rows, own, n, copy, turn = fresh(docs, "doc", "source_", "size", "total", "rows", "own", "n", "copy", "turn")
    per = copies.groupBy("doc_id", "source_no", "size").agg(F.sum("copies").alias(total), F.count(F.lit(1)).alias(rows))
    per = per.join(sources.select(F.col("source").alias(source), "source_no"), "source_no")
    per = per.select(F.col("doc_id").alias(doc), source, F.col("size").alias(size), total, rows)
    sized = docs.withColumn(own, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(own) == F.col(size))
    met = sized.join(per, same)
    order = Window.partitionBy(doc, source, size).orderBy(row_hash(docs))
    alone = met.where(F.col(rows) == 1).withColumn(turn, F.lit(0))
    met = alone.union(met.where(F.col(rows) > 1).withColumn(turn, F.row_number().over(order) - 1))
    times = F.floor(F.col(total) / F.col(rows)) + (F.col(turn) < F.col(total) % F.col(rows)).cast("long")
    met = met.withColumn(n, times.cast("int")).where(F.col(n) > 0)
    return met.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*own_columns(docs))
