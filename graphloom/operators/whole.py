"""Queries over the whole index: tree, graph, lines of code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..schemas import IndexTables


def tree(index: IndexTables, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every file with its numbers of objects and methods; nodes are counted before the join, or once for a snapshot."""
    if index.file_counts is not None:
        return index.file_counts.select(*keep, "id", "path", "lang", "pkg", "objects", "methods")
    per_file = index.nodes.groupBy("file_id").agg(
        F.count_if(F.col("kind") == "object").alias("objects"), F.count_if(F.col("kind") == "method").alias("methods")
    )
    out = index.files.join(per_file, "file_id", "left").na.fill(0, ["objects", "methods"])
    return out.select(*keep, F.concat(F.lit("f"), F.col("short_id").cast("string")).alias("id"), F.col("rel_path").alias("path"), "lang", F.col("package").alias("pkg"), "objects", "methods")


def graph_nodes(index: IndexTables) -> DataFrame:
    f_id = F.concat(F.lit("f"), F.col("short_id").cast("string"))
    files = index.files.select(
        f_id.alias("id"), F.lit("file").alias("k"), F.regexp_extract("rel_path", r"([^/]*)$", 1).alias("name"), F.col("rel_path").alias("path"),
        "lang", F.lit("").alias("subk"), F.lit(0).alias("l"), F.lit(None).cast("string").alias("owner"), F.lit(None).cast("string").alias("file"),
    )
    places = index.files.select("file_id", "rel_path", "lang", f_id.alias("file"))
    owners = index.nodes.select(F.col("node_id").alias("owner_id"), ids.short_id(F.col("kind"), F.col("short_id")).alias("owner"))
    nodes = index.nodes.join(places, "file_id").join(owners, "owner_id", "left").select(
        ids.short_id(F.col("kind"), F.col("short_id")).alias("id"), F.col("kind").alias("k"), "name", F.col("rel_path").alias("path"),
        "lang", F.col("subkind").alias("subk"), F.col("start_line").alias("l"), "owner", "file",
    )
    return files.unionByName(nodes)


def graph_edges(index: IndexTables) -> DataFrame:
    """(src, dst, t, rel): defines, and the resolved calls, inherits and imports, by canonical ids."""
    empty = F.lit("").alias("rel")
    defines = index.nodes.select(F.coalesce("owner_id", "file_id").alias("src"), F.col("node_id").alias("dst"), F.lit("defines").alias("t"), empty)
    calls = index.edges_calls.where("callee_id is not null").select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"), F.lit("calls").alias("t"), empty)
    inherits = index.edges_inherits.where("parent_id is not null").select(
        F.col("child_id").alias("src"), F.col("parent_id").alias("dst"), F.lit("inherits").alias("t"), F.col("relation").alias("rel")
    )
    imports = index.edges_imports.where("target_file_id is not null").select(
        F.col("file_id").alias("src"), F.col("target_file_id").alias("dst"), F.lit("imports").alias("t"), empty
    )
    return defines.unionByName(calls).unionByName(inherits).unionByName(imports)


def graph_edges_short(index: IndexTables) -> DataFrame:
    """The edges by short ids; edges whose ends are not in the index go."""
    known = index.nodes.select("node_id", ids.short_id(F.col("kind"), F.col("short_id")).alias("sid")).unionByName(
        index.files.select(F.col("file_id").alias("node_id"), F.concat(F.lit("f"), F.col("short_id").cast("string")).alias("sid"))
    )
    a = known.select(F.col("node_id").alias("src"), F.col("sid").alias("from"))
    b = known.select(F.col("node_id").alias("dst"), F.col("sid").alias("to"))
    return graph_edges(index).join(a, "src").join(b, "dst").select("from", "to", "t", "rel")


def graph(index: IndexTables) -> tuple[DataFrame, DataFrame]:
    return graph_nodes(index), graph_edges_short(index)


def code_lines(content: Column, start: Column, end: Column, context: int = 0) -> Column:
    """Lines start - context to end + context (from 1) of a text; a return before a line's end is taken off."""
    lines = F.split(F.regexp_replace(content, "\r\n", "\n"), "\n")
    first = F.greatest(start - context, F.lit(1))
    return F.array_join(F.slice(lines, first, F.greatest(end + context - first + 1, F.lit(0))), "\n")
