"""Changes of a source tree: by content hash between two scans, and as a stream of its files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..sources import tree_source
from ..sources.parse import parse_files


def fingerprints(files: DataFrame) -> DataFrame:
    return files.select("key", F.sha2("content", 256).alias("hash"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, change): added, removed or modified between two sets of (key, hash)."""
    o, n = old.select("key", F.col("hash").alias("_o")), new.select("key", F.col("hash").alias("_n"))
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "modified")
    return o.join(n, "key", "full").select("key", kind.alias("change")).where("change is not null")


def stream_parsed(spark: SparkSession, root: str, extensions: list[str], on_batch, checkpoint: str, prefix: str = "", patterns: list[str] | None = None):
    """Parses files under root as they appear or change and hands each batch's parsed rows to on_batch(df, batch number)."""
    tree_source.register(spark)
    rows = spark.readStream.format("tree").options(**tree_source.options(root, extensions, prefix, patterns)).load()
    rows = rows.select("key", "rel_path", ids.lang_from_path(F.col("rel_path")).alias("lang"), "content")

    def handle(batch: DataFrame, number: int) -> None:
        on_batch(parse_files(batch), number)

    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
