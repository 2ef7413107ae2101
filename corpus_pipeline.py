"""A corpus pipeline of five stages over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import cost_packing, entropy_mix, jaccard_groups, language_backoff, ngram_quality
from graphloom.llm.queries import TOKENIZER, id_crc
from graphloom.llm.shared import delete_folder, ensure_checkpoint_dir, fresh, gathered, own_columns, row_hash, small


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognizable language: no letter, or under half of the probability on one language.

    Null and blank texts go; null ids, null languages and repeated rows are judged like others; with no row to learn from
    all go; columns of any name stay as they are; an empty table gives no rows.
    """
    model = language_backoff.fit(docs, id_crc() % 3 != 1)
    lang, score = fresh(docs, "lang_pred", "lang_score")
    out = language_backoff.predict(docs, model, (lang, score))
    return out.where((F.col(lang) != "und") & (F.col(score) >= 0.5)).select(*own_columns(docs))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the base rules or their language's perplexity band reject.

    Null, blank and short texts go; null languages are one language; repeated rows are judged one by one; columns of any
    name stay as they are; an empty table gives no rows.
    """
    return ngram_quality.keep(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group linked by Jaccard similarities of 0.8 or more over five-word shingles: that of smallest
    id (nulls last), then of smallest hash over all columns; rows that are equal in all columns are one.

    Texts without words are one group; columns of any name stay as they are; an empty table gives no rows.
    """
    row, n = fresh(docs, "row", "n")
    each = gathered(jaccard_groups.groups(docs).groupBy("row", "doc_id", "group").agg(F.count(F.lit(1)).alias("n")))
    best = each.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "n")).alias("best"))
    best = gathered(best.select(F.col("best.row").alias(row), F.col("best.n").alias(n)))
    repeated = gathered(best.where(F.col(n) > 1).select(row))
    others = gathered(each.select(F.col("row").alias(row)).join(best, row, "left_anti").unionByName(repeated).distinct())
    named = docs.withColumn(row, row_hash(docs))
    once = named.join(small(others), row, "left_anti")
    one_of_many = named.join(small(repeated), row, "left_semi").dropDuplicates([row])
    return once.union(one_of_many.select(*own_columns(once))).select(*own_columns(docs))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents as often as the mix takes them, none to twice.

    Null texts have size 0 and null sources are a source; repeated rows share their copies in the order of a hash; columns
    of any name stay as they are; an empty table gives no rows.
    """
    return entropy_mix.apply_mix(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 1024 tokens.

    Null texts are empty, null ids stay null, repeated rows are packed one by one; other columns are not carried; an empty
    table gives no rows.
    """
    return cost_packing.pack(docs, TOKENIZER, 1024)


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("mix", mix_stage),
    ("pack", pack_stage),
]

#: Tokenization and the fitted models are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. Each stage's result is written to the shared folder and read again; what the stages
    before it have written there is deleted then, and the last result stays, as the caller reads it."""
    import uuid

    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete_folder(spark, f"{folder}/{k - 1}")
    return docs
