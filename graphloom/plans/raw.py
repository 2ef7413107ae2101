"""From parsed files to raw tables: canonical names, short ids, and explicit places for all order-dependent rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import ids


@dataclass(frozen=True)
class RawTables:
    """files(file_id, file_no, key, rel_path, lang, package, module, prefix); objects and methods with node ids and
    short ids; bases, calls, imports and var_types with their place (`ord`) in the file."""

    files: DataFrame
    objects: DataFrame
    methods: DataFrame
    bases: DataFrame
    calls: DataFrame
    imports: DataFrame
    var_types: DataFrame


def number_files(files: DataFrame) -> DataFrame:
    """Adds file_no, dense from 1 in walk order: entries of a directory by name, so paths compare by their parts.

    Files are numbered within range partitions of the order, shifted by the counts of the partitions before. The rows are
    read three times, for their number, the ranges and the numbers, so they should be cut and have few columns.
    """
    spark = files.sparkSession
    parts = F.split("rel_path", "/")
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-files.count() // 4096)))
    ranged = files.withColumn("_parts", parts).repartitionByRange(n, "_parts", "key").withColumn("_part", F.spark_partition_id())
    ranged = cut(ranged)
    counts = dict(map(tuple, ranged.groupBy("_part").count().collect()))  # a row for each partition
    shift, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        shift.append(total)
        total += counts.get(p, 0)
    base = F.element_at(F.array(*[F.lit(x).cast("long") for x in shift or [0]]), F.col("_part") + 1)
    row = F.row_number().over(Window.partitionBy("_part").orderBy("_parts", "key"))
    return ranged.withColumn("file_no", base + row).drop("_part", "_parts")


def raw_tables(parsed: DataFrame) -> RawTables:
    """parsed: key, rel_path, lang and the columns of schemas.PARSED, one row per file that could be parsed."""
    p = cut(parsed.withColumn("_row", F.monotonically_increasing_id()))
    # numbers are made from names and counts alone; what was parsed is moved once, to meet them
    sized = number_files(p.select("_row", "key", "rel_path", (F.size("objects") + F.size("methods")).alias("_n")))
    # nodes before each file: sums over blocks of files, then within the block
    block = sized.withColumn("_block", F.floor((F.col("file_no") - 1) / 4096))
    sums = block.groupBy("_block").agg(F.sum("_n").alias("_s"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of 4096 files
    base = sums.select("_block", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_block").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    numbers = block.withColumn("_in", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(base, "_block")
    numbers = numbers.select("_row", "file_no", (F.col("_base") + F.col("_in")).alias("node_base"))
    # sizes are estimated from what the files were listed in, so without the hint all that was parsed could be broadcast
    p = p.hint("merge").join(numbers, "_row").drop("_row").withColumn("file_id", ids.file_id(F.col("key"))).withColumn("module", ids.module_name(F.col("rel_path")))
    p = cut(p.withColumn("prefix", F.when(F.col("lang") == "python", F.col("module")).otherwise("")))
    head = ["file_id", "file_no", "key", "lang", "prefix"]
    canon = lambda c: ids.prefixed(F.col("prefix"), F.col(c))

    o = p.select(*head, "node_base", F.posexplode("objects").alias("ord", "o"))
    o = o.select(*head, "ord", (F.col("node_base") + F.col("ord") + 1).alias("short_id"), "o.*").withColumn("fqn", canon("fqn"))
    o = o.withColumn("node_id", ids.node_id(F.col("lang"), F.lit("object"), F.col("fqn"), F.col("key"), F.col("start_line")))
    m = p.select(*head, (F.col("node_base") + F.size("objects")).alias("_b"), F.posexplode("methods").alias("ord", "m"))
    m = m.select(*head, "ord", (F.col("_b") + F.col("ord") + 1).alias("short_id"), "m.*").withColumn("fqn", canon("fqn")).withColumn("owner_fqn", canon("owner_fqn"))
    m = m.withColumn("node_id", ids.node_id(F.col("lang"), F.lit("method"), F.col("fqn"), F.col("key"), F.col("start_line")))
    bases = o.select("node_id", "file_id", "prefix", F.posexplode("bases").alias("ord", "b")).select(
        F.col("node_id").alias("child_id"), "file_id", "prefix", "ord", F.col("b.name").alias("hint"), F.col("b.relation").alias("relation")
    )
    c = p.select(*head, F.posexplode("calls").alias("ord", "c")).select(*head, "ord", "c.*").withColumn("caller_fqn", canon("caller_fqn"))
    i = p.select(*head, "module", F.posexplode("imports").alias("ord", "i")).select(*head, "module", "ord", "i.*")
    i = i.withColumn("raw", F.when(F.col("lang") == "python", ids.relative_import(F.col("raw"), F.col("module"))).otherwise(F.col("raw")))
    v = p.select(*head, F.posexplode("var_types").alias("ord", "v")).select(*head, "ord", "v.*").withColumn("scope_fqn", canon("scope_fqn"))
    return RawTables(
        files=p.select("file_id", "file_no", "key", "rel_path", "lang", "package", "module", "prefix"),
        objects=o.select("node_id", "short_id", "file_id", "ord", "name", "fqn", "subkind", "doc", "start_line", "end_line"),
        methods=m.select("node_id", "short_id", "file_id", "name", "fqn", "owner_fqn", "subkind", "scope", "signature", "doc", "start_line", "end_line"),
        bases=bases,
        calls=c.select("file_id", "ord", "caller_fqn", "callee_name", "callee_owner", "line"),
        imports=i.select("file_id", "ord", "raw", "alias"),
        var_types=v.select("file_no", "ord", "scope_fqn", "var_name", "type_name"),
    )
