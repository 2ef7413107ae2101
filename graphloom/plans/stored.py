"""What a snapshot keeps beside its tables, so that a question about one symbol reads a few rows and not the index.

- adjacency: every walk's rows in both directions, by edge type, direction and node: an edge table and its reverse, with what
  a walk shows of the other end, so a walk is a filter and joins nothing;
- ids: canonical ids by short id;
- node_counts, file_counts, totals: counts made once in the write pass.

Each table is range-partitioned and sorted by what it is asked for, and written in small row groups and pages, so the
minima and maxima of both leave little to read; paths and names, which files and nodes aren't sorted by, have bloom filters.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import delete, tidy
from ..operators import lookups, walks, whole
from ..schemas import STORED, IndexTables

#: What each table is sorted by, and the columns with bloom filters. Search documents are only read whole.
KEYS = {
    "files": ["file_id"], "nodes": ["node_id"], "edges_calls": ["caller_id"], "edges_inherits": ["child_id"], "edges_imports": ["file_id"],
    "postings": ["term", "block"], "posting_blocks": ["term", "block"], "doc_stats": ["doc_id"], "adjacency": ["edge", "dir", "node"], "ids": ["kind", "short_id"],
    "node_counts": ["node_id"], "file_counts": ["file_id"], "nodes_of_file": ["file_id", "start_line"],
}
BLOOM = {"files": ["rel_path"]}
#: Row groups and pages of the tables that lookups read.
ROW_GROUP, PAGE_ROWS = 8 << 20, 2_000


#: Tables of more rows get ranges of so many, which a task sorts in memory; adaptive plans go by packed bytes, and would make
#: larger ones. A table of postings is made from documents of so many terms a task.
RANGE_ROWS = TASK_TERMS = 1_000_000


def write_sorted(df: DataFrame, path: str, name: str) -> None:
    """df under path/name, sorted by the table's keys. What it is made from is computed once: the ranges are found in a
    packed copy, which goes then; a checkpoint would hold the rows unpacked until the driver ends. Of a large table, the shuffle
    files of what it is made from go before its rows are moved."""
    keys, made, spark = KEYS.get(name), f"{path}/_made/{name}", df.sparkSession
    if keys:
        schema = df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(made)
        copy = spark.read.schema(schema).parquet(made)
        del df
        rows, ranges = copy.count(), []
        if rows > RANGE_ROWS:
            tidy(spark)
            ranges = [max(spark.sparkContext.defaultParallelism, rows // RANGE_ROWS)]
        df = copy.repartitionByRange(*ranges, *keys).sortWithinPartitions(*keys)
    out = df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).option("parquet.page.row.count.limit", PAGE_ROWS)
    for column in BLOOM.get(name, []):
        out = out.option(f"parquet.bloom.filter.enabled#{column}", "true")
    out.parquet(f"{path}/{name}")
    if keys:
        delete(spark, made)


def adjacency(index: IndexTables) -> DataFrame:
    return walks.every_walk(index)


def ids(index: IndexTables) -> DataFrame:
    of_files = index.files.select(F.lit("file").alias("kind"), "short_id", F.col("file_id").alias("canonical_id"))
    return of_files.unionByName(index.nodes.select("kind", "short_id", F.col("node_id").alias("canonical_id")))


def node_counts(index: IndexTables) -> DataFrame:
    none = lambda *names: [F.lit(0).cast("long").alias(n) for n in names]
    objects = lookups.object_counts(index).select("node_id", "methods", "extends", "implements", "extended_by", *none("calls", "called_by", "unresolved"))
    methods = lookups.method_counts(index).select("node_id", *none("methods", "extends", "implements", "extended_by"), "calls", "called_by", "unresolved")
    return objects.unionByName(methods)


def file_counts(index: IndexTables) -> DataFrame:
    """The rows of the tree with their file's id and number of imports."""
    imports = index.edges_imports.groupBy("file_id").agg(F.count(F.lit(1)).alias("imports"))
    tree = whole.tree(index, keep=("file_id",))
    return tree.join(imports, "file_id", "left").na.fill(0, ["imports"]).select("file_id", "id", "path", "lang", "pkg", "objects", "methods", "imports")


def nodes_of_file(index: IndexTables) -> DataFrame:
    """The nodes by their file, objects with the number of their children."""
    children = index.nodes.where("owner_id is not null").groupBy(F.col("owner_id").alias("node_id")).agg(F.count(F.lit(1)).alias("methods"))
    own = index.nodes.select("file_id", "node_id", "short_id", "kind", "subkind", "name", "owner_id", "start_line", "end_line")
    return own.join(children, "node_id", "left").na.fill(0, ["methods"]).select(*own.columns, "methods")


MADE = {"adjacency": adjacency, "ids": ids, "node_counts": node_counts, "file_counts": file_counts, "nodes_of_file": nodes_of_file, "totals": lookups.stats}


def write_derived(spark: SparkSession, path: str) -> None:
    """The derived tables of the six that lie under path. The walks, which are the largest by far, are written alone, and what
    their shuffles have left on the disks goes before the others begin."""
    index = IndexTables.read(spark, path, ())
    assert set(MADE) == set(STORED)
    steps = {name: lambda name=name, make=make: write_sorted(make(index), path, name) for name, make in MADE.items()}
    at_once(spark, [steps.pop("adjacency")])
    at_once(spark, list(steps.values()))


def at_once(spark: SparkSession, steps: list) -> None:
    """Runs jobs that don't depend on each other beside each other: those of small tables would leave most of a cluster idle.
    Their shuffle files go when all have ended."""
    with ThreadPoolExecutor(4) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]:
            done.result()
    tidy(spark)
