"""Point lookups and counts. Each takes the index and works for all rows; callers filter to the ids they want."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..schemas import IndexTables


def resolve_ids(index: IndexTables, wanted: DataFrame, col: str = "id") -> DataFrame:
    """(id, canonical_id, doc_kind): canonical ids pass unverified, short ids are looked up, the kind must match."""
    kind, number = ids.parse_short_id(F.col(col))
    asked = wanted.select(F.col(col).alias("id"), kind.alias("_kind"), number.alias("_no"))
    if index.ids is not None:
        known = index.ids.select(F.col("kind").alias("_kind"), F.col("short_id").alias("_no"), F.col("canonical_id").alias("_id"))
    else:
        known = index.nodes.select(F.col("kind").alias("_kind"), F.col("short_id").alias("_no"), F.col("node_id").alias("_id")).unionByName(
            index.files.select(F.lit("file").alias("_kind"), F.col("short_id").alias("_no"), F.col("file_id").alias("_id"))
        )
    own = F.when(F.col("id").rlike("^[nf]:"), F.col("id"))
    found = asked.join(known, ["_kind", "_no"], "left").select("id", F.coalesce(own, "_id").alias("canonical_id"))
    return found.where("canonical_id is not null").select(
        "id", "canonical_id", F.when(F.col("canonical_id").startswith("f:"), "file").otherwise("node").alias("doc_kind")
    )


def find_id(index: IndexTables, short: str) -> DataFrame:
    """(canonical_id) of one short id: a filter that reaches the scan of the stored ids, where there are some."""
    kind, number = ids.parse_short(short)
    if index.ids is not None:
        return index.ids.where((F.col("kind") == kind) & (F.col("short_id") == number)).select("canonical_id")
    of = index.files.withColumn("kind", F.lit("file")) if kind == "file" else index.nodes
    found = of.where((F.col("kind") == kind) & (F.col("short_id") == number))
    return found.select(F.col("file_id" if kind == "file" else "node_id").alias("canonical_id"))


def get_node(index: IndexTables) -> DataFrame:
    files = index.files.select("file_id", F.col("short_id").alias("file_no"), "rel_path", "lang")
    owners = index.nodes.select(F.col("node_id").alias("owner_id"), F.col("short_id").alias("owner_no"))
    nodes = index.nodes.join(files, "file_id")
    # nodes without an owner don't meet the join, whose null key would bring all of them into one task
    owned = nodes.where("owner_id is not null").join(owners, "owner_id", "left")
    free = nodes.where("owner_id is null").withColumn("owner_no", F.lit(None).cast("long"))
    return owned.unionByName(free).select(
        "node_id", "short_id", "kind", "subkind", "name", "fqn", "owner_id", "owner_no", "scope", "signature", "doc",
        "start_line", "end_line", "file_id", "file_no", "rel_path", "lang",
    )


def object_counts(index: IndexTables) -> DataFrame:
    """(node_id, methods, extends, implements, extended_by) of every object; all its children count as methods."""
    if index.node_counts is not None:
        objects = index.nodes.where("kind = 'object'").select("node_id")
        return index.node_counts.join(objects, "node_id", "left_semi").select("node_id", "methods", "extends", "implements", "extended_by")
    children = index.nodes.where("owner_id is not null").groupBy(F.col("owner_id").alias("node_id")).agg(F.count(F.lit(1)).alias("methods"))
    out = index.edges_inherits.groupBy(F.col("child_id").alias("node_id")).agg(
        F.count_if(F.col("relation") == "extends").alias("extends"), F.count_if(F.col("relation") == "implements").alias("implements")
    )
    into = index.edges_inherits.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("extended_by"))
    objects = index.nodes.where("kind = 'object'").select("node_id")
    return objects.join(children, "node_id", "left").join(out, "node_id", "left").join(into, "node_id", "left").na.fill(0)


def method_counts(index: IndexTables) -> DataFrame:
    """(node_id, calls, called_by, unresolved) of every method."""
    if index.node_counts is not None:
        methods = index.nodes.where("kind = 'method'").select("node_id")
        return index.node_counts.join(methods, "node_id", "left_semi").select("node_id", "calls", "called_by", "unresolved")
    out = index.edges_calls.groupBy(F.col("caller_id").alias("node_id")).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("callee_id").isNull()).alias("unresolved")
    )
    into = index.edges_calls.where("callee_id is not null").groupBy(F.col("callee_id").alias("node_id")).agg(F.count(F.lit(1)).alias("called_by"))
    methods = index.nodes.where("kind = 'method'").select("node_id")
    return methods.join(out, "node_id", "left").join(into, "node_id", "left").na.fill(0).select("node_id", "calls", "called_by", "unresolved")


def get_file(index: IndexTables, path_or_id: str) -> DataFrame:
    col = "file_id" if path_or_id.startswith("f:") else "rel_path"
    return index.files.where(F.col(col) == path_or_id)


def file_imports(index: IndexTables) -> DataFrame:
    """(file_id, raw, target_no), to be ordered by raw."""
    targets = index.files.select(F.col("file_id").alias("target_file_id"), F.col("short_id").alias("target_no"))
    return index.edges_imports.join(targets, "target_file_id", "left").select("file_id", "raw", "target_no")


def file_objects(index: IndexTables) -> DataFrame:
    """(file_id, node_id, short_id, subkind, name, start_line, end_line, methods), to be ordered by start_line."""
    if index.nodes_of_file is not None:
        return index.nodes_of_file.where("kind = 'object'").drop("kind", "owner_id")
    children = index.nodes.where("owner_id is not null").groupBy(F.col("owner_id").alias("node_id")).agg(F.count(F.lit(1)).alias("methods"))
    own = index.nodes.where("kind = 'object'").select("file_id", "node_id", "short_id", "subkind", "name", "start_line", "end_line")
    return own.join(children, "node_id", "left").na.fill(0, ["methods"]).select(*own.columns, "methods")


def file_top_methods(index: IndexTables) -> DataFrame:
    """Methods without an owner, to be ordered by start_line."""
    nodes = index.nodes if index.nodes_of_file is None else index.nodes_of_file
    own = nodes.where("kind = 'method' and owner_id is null")
    return own.select("file_id", "node_id", "short_id", "subkind", "name", "start_line", "end_line")


def code_range(index: IndexTables) -> DataFrame:
    files = index.files.select("file_id", "key", "rel_path")
    return index.nodes.join(files, "file_id").select("node_id", "short_id", "kind", "file_id", "key", "rel_path", "start_line", "end_line")


def stats(index: IndexTables) -> DataFrame:
    """One row of nine counts."""
    if index.totals is not None:
        return index.totals
    parts = [
        index.files.agg(F.count(F.lit(1)).alias("files")),
        index.nodes.agg(F.count_if(F.col("kind") == "object").alias("objects"), F.count_if(F.col("kind") == "method").alias("methods")),
        index.edges_calls.agg(
            F.count_if(F.col("callee_id").isNotNull()).alias("calls_resolved"), F.count_if(F.col("callee_id").isNull()).alias("calls_unresolved")
        ),
        index.edges_inherits.agg(F.count(F.lit(1)).alias("inherits")),
        index.edges_imports.agg(
            F.count_if(F.col("target_file_id").isNotNull()).alias("imports_resolved"), F.count_if(F.col("target_file_id").isNull()).alias("imports_external")
        ),
        index.search_docs.agg(F.count(F.lit(1)).alias("search_docs")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # single rows
    return out
