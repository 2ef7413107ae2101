"""Ranked search: postings, BM25 and the top hits."""

from __future__ import annotations

import functools
import math
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analyzer import index_terms, n_index_terms, normalize

#: The weights that take effect on name, fqn and path, and BM25's constants.
WEIGHTS = {"name": 4.0, "fqn": 1.0, "path": 1.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf_name, tf_fqn, tf_path)."""
    parts = F.array(*[F.struct(F.lit(c).alias("col"), index_terms(F.coalesce(c, F.lit(""))).alias("terms")) for c in WEIGHTS])
    each = docs.select("doc_id", F.explode(parts).alias("p")).select("doc_id", "p.col", F.explode("p.terms").alias("term"))
    return each.groupBy("term", "doc_id").agg(*[F.count_if(F.col("col") == c).cast("int").alias(f"tf_{c}") for c in WEIGHTS])


def doc_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_kind, len): tokens in all columns."""
    size = sum((n_index_terms(F.coalesce(c, F.lit(""))) for c in WEIGHTS), F.lit(0))
    return docs.select("doc_id", "doc_kind", size.cast("int").alias("len"))


#: Documents of a block of postings: those of neighbouring short ids, so mostly of the same files.
BLOCK_DOCS = 1024


def blocked_stats(stats: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_stats with the block of each document; ids: kind, short_id, canonical_id. Files have negative blocks, and so have
    documents without a short id, which are dealt by their hash."""
    at = F.floor(F.col("short_id") / BLOCK_DOCS)
    block = F.when(F.col("kind") == "file", -1 - 2 * at).otherwise(at).cast("long")
    dealt = -2 - 2 * F.pmod(F.xxhash64("doc_id"), F.lit(max(1, stats.count() // BLOCK_DOCS)))
    out = stats.join(ids.select(F.col("canonical_id").alias("doc_id"), block.alias("_block")), "doc_id", "left")
    return out.select("doc_id", "doc_kind", "len", F.coalesce("_block", dealt).alias("block"))


def blocked_postings(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """The postings with what scoring needs of their document, so that a search reads nothing else."""
    # a hash join, as postings that are dealt by document would be sorted for nothing
    return posts.join(stats.hint("shuffle_hash"), "doc_id").select("term", "doc_id", "doc_kind", "block", "len", "tf_name", "tf_fqn", "tf_path")


def frequency() -> Column:
    """The weighted count of a posting."""
    return sum((F.col(f"tf_{c}") * w for c, w in WEIGHTS.items()), F.lit(0.0))


def posting_blocks(posts: DataFrame) -> DataFrame:
    """(term, block, n, max_f, min_len): from these follows the most that a term can add to a document of the block."""
    return posts.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.max(frequency()).alias("max_f"), F.min("len").alias("min_len"))


def search_stats(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("total_len"))


def query_terms(spark, text: str, stop_words: list[str] | None = None) -> list[str]:
    """Normalized terms of a query; a term that ends in * matches by prefix, other marks separate."""
    terms = F.transform(normalize(F.lit(text), stop_words), lambda t: F.struct(t.alias("term"), index_terms(t).alias("words")))
    out = []
    for term, words in spark.range(1).select(terms.alias("t")).first()["t"]:
        out += [w + ("*" if term.endswith("*") and i == len(words) - 1 else "") for i, w in enumerate(words)]
    return list(dict.fromkeys(out))


def _matches(term: Column, wanted: str) -> Column:
    return term.startswith(wanted[:-1]) if wanted.endswith("*") else term == wanted


def bm25(docs: DataFrame, terms: list[str], posts: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """(doc_id, doc_kind, score) of the documents that hold all terms; lower scores are better.

    A prefix counts as one term: its words' frequencies add up. Terms are few, so the counts per term are a row each.
    With stored postings, which are sorted by term, the filter reads the row groups of the terms alone.
    """
    posts = postings(docs) if posts is None else posts
    stats = doc_stats(docs) if stats is None else stats
    which = F.array_compact(F.array(*[F.when(_matches(F.col("term"), t), F.lit(i)) for i, t in enumerate(terms)]))
    any_of = functools.reduce(operator.or_, [_matches(F.col("term"), t) for t in terms])
    hits = posts.where(any_of).select(F.explode(which).alias("t"), "doc_id", frequency().alias("f")).groupBy("t", "doc_id").agg(F.sum("f").alias("f"))
    found = hits.groupBy("t").agg(F.count(F.lit(1)).alias("n_t"))
    size = stats.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))
    idf = F.log((F.col("n_docs") - F.col("n_t") + 0.5) / (F.col("n_t") + 0.5))
    rated = found.crossJoin(size).select("t", "avg_len", F.when(idf <= 0, LEAST_IDF).otherwise(idf).alias("idf"))  # a row for each query term
    part = _part(F.col("idf"), F.col("avg_len"))
    scored = hits.join(F.broadcast(rated), "t").join(stats.select("doc_id", "doc_kind", "len"), "doc_id")
    return _totals(scored, part, len(terms))


def _part(idf: Column, avg_len: Column) -> Column:
    """What a term of weighted count `f` adds to a document of `len` tokens; grows with f, falls with len."""
    return idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / avg_len))


def _totals(hits: DataFrame, part: Column, n: int) -> DataFrame:
    """The scores of documents that have all n terms. Parts are added in the order of the terms, so that documents that are
    alike get equal scores to the last digit, however rows meet."""
    parts = [F.sum(F.when(F.col("t") == i, part)).alias(f"_p{i}") for i in range(n)]
    score = functools.reduce(operator.add, [F.col(f"_p{i}") for i in range(n)])
    total = hits.groupBy("doc_id", "doc_kind").agg(*parts).select("doc_id", "doc_kind", (-score).alias("score"))
    return total.where("score is not null")


class BlockSearch:
    """The best documents of a stored index for some terms, from the blocks of postings that can hold them.

    Of each block the summary tells the most that each term can add there, so the sum bounds every document of the block; blocks
    that lack a term hold no match. The blocks of highest bounds are scored first, and of the others only those whose bound
    reaches the k-th best score found. Only summaries and postings of the query's terms are read, and one row of statistics.
    """

    #: Blocks that are scored first; blocks named in a filter of the scan, above which they are joined.
    FIRST, NAMED = 32, 4_096

    def __init__(self, index, terms: list[str], k: int):
        self.index, self.terms, self.k = index, terms, k
        self.which = F.array_compact(F.array(*[F.when(_matches(F.col("term"), t), F.lit(i)) for i, t in enumerate(terms)]))
        self.any_of = functools.reduce(operator.or_, [_matches(F.col("term"), t) for t in terms])
        self.blocks_scored = 0

    def _idf(self, summaries: DataFrame, n_docs: int) -> Column:
        """The weight of each term, by the number of documents that hold it; a prefix counts each once."""
        found = {r["t"]: r["n"] for r in summaries.groupBy("t").agg(F.sum("n").alias("n")).collect()}  # a row a term
        for i, t in enumerate(self.terms):
            if t.endswith("*"):
                found[i] = self.index.postings.where(_matches(F.col("term"), t)).select("doc_id").distinct().count()
        raw = [math.log((n_docs - n + 0.5) / (n + 0.5)) for n in (found.get(i, 0) for i in range(len(self.terms)))]
        return F.element_at(F.array(*[F.lit(x if x > 0 else LEAST_IDF) for x in raw]), F.col("t") + 1)

    def _scores(self, chosen: DataFrame, idf: Column, avg_len: Column) -> DataFrame:
        hits = chosen.select(F.explode(self.which).alias("t"), "doc_id", "doc_kind", "len", frequency().alias("f"))
        hits = hits.groupBy("t", "doc_id", "doc_kind", "len").agg(F.sum("f").alias("f"))
        return _totals(hits, _part(idf, avg_len), len(self.terms))

    def _within(self, blocks: list[int]) -> DataFrame:
        return self.index.postings.where(self.any_of & F.col("block").isin(blocks))

    def scored(self) -> DataFrame:
        """(doc_id, doc_kind, score): the k best, and others beside them."""
        size = self.index.search_stats.first()
        avg_len = F.lit(size["total_len"] / max(size["n_docs"], 1) or 1.0)
        rows = self.index.posting_blocks.where(self.any_of).select(F.explode(self.which).alias("t"), "block", "n", "max_f", "min_len")
        rows = rows.groupBy("t", "block").agg(F.sum("n").alias("n"), F.sum("max_f").alias("f"), F.min("min_len").alias("len"))
        idf = self._idf(rows, size["n_docs"])
        blocks = rows.groupBy("block").agg(F.count(F.lit(1)).alias("_n"), F.sum(_part(idf, avg_len)).alias("bound")).where(F.col("_n") == len(self.terms))
        first = [r["block"] for r in blocks.orderBy(F.col("bound").desc(), "block").limit(self.FIRST).collect()]
        self.blocks_scored = len(first)
        best = self._scores(self._within(first), idf, avg_len)
        if len(first) < self.FIRST:
            return best
        kth = best.orderBy("score").offset(self.k - 1).limit(1).collect()
        # bounds are summed in another order than scores, so the last digits may differ
        rest = blocks.where(~F.col("block").isin(first) & (F.col("bound") * (1 + 1e-9) >= (-kth[0]["score"] if kth else 0.0))).select("block")
        named = [r["block"] for r in rest.limit(self.NAMED + 1).collect()]
        self.blocks_scored += len(named) if len(named) <= self.NAMED else rest.count()
        if not named:
            return best
        if len(named) <= self.NAMED:
            return best.unionByName(self._scores(self._within(named), idf, avg_len))
        return best.unionByName(self._scores(self.index.postings.where(self.any_of).join(rest, "block", "left_semi"), idf, avg_len))


def top_hits(scored: DataFrame, limit: int = 10, kind: str | None = None, filter_first: bool = False) -> DataFrame:
    """The best `limit` hits: by default the kind is looked at behind a cut of four times the limit."""
    limit = limit if limit > 0 else 10
    order = [F.col("score"), F.col("doc_id")]
    wanted = F.col("doc_kind") == kind if kind else F.lit(True)
    if filter_first:
        return scored.where(wanted).orderBy(*order).limit(limit)
    return scored.orderBy(*order).limit(4 * limit).where(wanted).orderBy(*order).limit(limit)


def enrich(hits: DataFrame, files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Name, kind, place and short id for each hit; hits without a row in the index go."""
    f = files.select(F.col("file_id").alias("doc_id"), F.col("short_id").alias("f_no"), F.col("rel_path").alias("f_path"), F.col("lang").alias("f_lang"))
    paths = files.select("file_id", "rel_path", "lang")
    n = nodes.join(paths, "file_id").select(
        F.col("node_id").alias("doc_id"), F.col("short_id").alias("n_no"), "kind", "name", "fqn", "start_line", "rel_path", "lang"
    )
    joined = hits.join(n, "doc_id", "left").join(f, "doc_id", "left").where("n_no is not null or f_no is not null")
    kind = F.coalesce("kind", F.lit("file"))
    mark = F.when(kind == "file", "f").when(kind == "object", "o").otherwise("m")
    return joined.select(
        "doc_id", F.concat(mark, F.coalesce("n_no", "f_no").cast("string")).alias("id"), kind.alias("k"),
        F.coalesce("name", F.regexp_extract("f_path", r"([^/]*)$", 1)).alias("name"), F.coalesce("fqn", F.lit("")).alias("fqn"),
        F.coalesce("rel_path", "f_path").alias("file"), F.coalesce("start_line", F.lit(0)).alias("l"), F.coalesce("lang", "f_lang").alias("lang"), "score",
    )


def search(index, text: str, kind: str | None = None, limit: int = 10, stop_words: list[str] | None = None) -> DataFrame:
    """The search of the API: hits of a text, best first."""
    docs = index.search_docs
    terms = query_terms(docs.sparkSession, re.sub(r"[\"'()^<>+{}\[\],;!?|&~`]", " ", text), stop_words)
    if not terms:
        scored = doc_stats(docs).where(F.lit(False)).select("doc_id", "doc_kind", F.lit(0.0).alias("score"))
    elif index.posting_blocks is not None:
        scored = BlockSearch(index, terms, 4 * (limit if limit > 0 else 10)).scored()
    else:
        scored = bm25(docs, terms, index.postings, index.doc_stats)
    if kind in ("object", "method"):
        # the cut comes first; kinds of nodes are known after the join
        top = scored.orderBy("score", "doc_id").limit(4 * (limit if limit > 0 else 10))
        return enrich(top, index.files, index.nodes).where(F.col("k") == kind).orderBy("score", "doc_id").limit(limit if limit > 0 else 10)
    kinds = {"file": "file", "node": "node"}
    return enrich(top_hits(scored, limit, kinds.get(kind or "")), index.files, index.nodes).orderBy("score", "doc_id")
