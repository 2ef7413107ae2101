"""Source trees as DataFrames.

Spark's own file sources leave out names that begin with an underscore or a dot, `__init__.py` among them, so the tree
is listed and read through Arrow's file systems (local, HDFS, S3, GCS), level by level, by tasks. Names are filtered by
expressions before any content is read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import files
from ..checkpoints import cut
from ..functions import ids
from .ignore import ignored

#: Files, and bytes, that a task hands on at once.
BATCH_FILES, BATCH_BYTES = 64, 16 << 20
#: Bytes of a piece of a file, where files are read in pieces.
PIECE_BYTES = 4 << 20

def has_extension(path: Column, extensions: list[str]) -> Column:
    """The extension test, blind to case; no extensions mean no filter."""
    if not extensions:
        return F.lit(True)
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin([e.lower() for e in extensions])


def list_tree(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """(rel_path, size, modified) of every file under root that no pattern hides, modified in nanoseconds; an error of a directory that is looked into fails the scan.

    The tree is listed level by level: tasks list the directories of a level, and those that a pattern matches are dropped
    before anything below them is touched. Levels are checkpointed.
    """
    from pyarrow.fs import FileSelector, FileType

    hidden = ignored(F.col("rel_path"), patterns or [])

    def entries(frames):
        fs, base = files.opened(root)
        for pdf in frames:
            for name in pdf["rel_path"]:
                found = fs.get_file_info(FileSelector(f"{base}/{name}" if name else base))
                rows = [(i.path[len(base) + 1 :], i.type == FileType.Directory, i.size or 0, i.mtime_ns or 0) for i in found if i.type != FileType.NotFound]
                yield pd.DataFrame(rows, columns=["rel_path", "is_dir", "size", "modified"]).astype({"is_dir": bool, "size": "int64", "modified": "int64"})

    out, level = None, spark.createDataFrame([("",)], "rel_path string")
    while True:
        found = cut(level.mapInPandas(entries, "rel_path string, is_dir boolean, size long, modified long").where(~hidden))
        own = found.where("not is_dir").select("rel_path", "size", "modified")
        out = own if out is None else out.unionByName(own)
        n = found.where("is_dir").count()
        if not n:
            return out
        level = found.where("is_dir").select("rel_path").repartition(max(1, min(n, 4 * spark.sparkContext.defaultParallelism)), "rel_path")


def read_file(root: str, rel_path: str) -> bytes:
    return files.read_bytes(f"{files.full(root).rstrip('/')}/{rel_path}")


def listing(spark: SparkSession, root: str, prefix: str = "", extensions: list[str] | None = None, patterns: list[str] | None = None) -> DataFrame:
    """(key, rel_path, lang, size, modified) of the files under root, without their content."""
    path = F.col("rel_path")
    wanted = list_tree(spark, root, patterns).where(has_extension(path, extensions or []))
    return wanted.select(F.concat(F.lit(prefix), path).alias("key"), "rel_path", ids.lang_from_path(path).alias("lang"), "size", "modified")


def dealt(rows: DataFrame, key: str | Column, least: int = 64) -> DataFrame:
    """rows over as many tasks as their number is worth, whatever their bytes are: names are small and what is made of them is
    large, so adaptive plans, which go by bytes, would leave a tree to one task. Counts the rows first."""
    n = rows.count()
    tasks = min(-(-n // least), max(4 * rows.sparkSession.sparkContext.defaultParallelism, n // 10_000))
    return rows.repartition(max(1, tasks), key)


def read_contents(listed: DataFrame, root: str) -> DataFrame:
    """The rows of a listing with their content; a file that is gone meanwhile fails the scan."""
    schema = listed.schema.add("content", "binary")

    def read(frames):
        fs, base = files.opened(root)
        for pdf in frames:
            first, content, size = 0, [], 0
            for at, name in enumerate(pdf["rel_path"]):
                with fs.open_input_stream(f"{base}/{name}") as f:
                    content.append(f.read())
                size += len(content[-1])
                if len(content) >= BATCH_FILES or size >= BATCH_BYTES or at + 1 == len(pdf):
                    yield pdf.iloc[first : at + 1].assign(content=content)
                    first, content, size = at + 1, [], 0

    # directories differ in size, so files are dealt anew by name
    return dealt(listed, "rel_path").mapInPandas(read, schema)


def scan(spark: SparkSession, root: str, prefix: str = "", extensions: list[str] | None = None, patterns: list[str] | None = None) -> DataFrame:
    """(key, rel_path, lang, content) of the files under root."""
    return read_contents(listing(spark, root, prefix, extensions, patterns), root).select("key", "rel_path", "lang", "content")


def read_pieces(listed: DataFrame, root: str) -> DataFrame:
    """The rows of a listing with the file's content in pieces: a row for each piece, with the place `at` of its first byte. Whole
    files may be larger than a task's memory, or than a value can be; a piece never is, and many tasks read one file. A file that
    is gone or shorter meanwhile fails the scan."""
    schema = listed.schema.add("at", "long").add("content", "binary")
    last = F.greatest(F.col("size") - 1, F.lit(0))
    pieces = listed.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(PIECE_BYTES).cast("long"))))
    piece = PIECE_BYTES

    def read(frames):
        fs, base = files.opened(root)
        for pdf in frames:
            for i, (name, size, at) in enumerate(zip(pdf["rel_path"], pdf["size"], pdf["at"])):
                wanted = min(piece, size - at)
                with fs.open_input_file(f"{base}/{name}") as f:
                    content = f.read_at(wanted, at) if wanted else b""
                if len(content) != wanted:
                    raise OSError(f"{name} is shorter than it was when it was listed")
                yield pdf.iloc[i : i + 1].assign(content=[content])

    # 8 pieces are 32 MB, whatever files they belong to
    return dealt(pieces, F.struct("rel_path", "at"), 8).mapInPandas(read, schema)


def scan_pieces(spark: SparkSession, root: str, prefix: str = "", extensions: list[str] | None = None, patterns: list[str] | None = None) -> DataFrame:
    """(key, rel_path, lang, size, at, content) of the files under root, whole, in pieces of bounded size."""
    return read_pieces(listing(spark, root, prefix, extensions, patterns), root).select("key", "rel_path", "lang", "size", "at", "content")
