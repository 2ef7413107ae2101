"""Edge walks: one hop along an edge type in one or both directions, with pages."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import ids
from ..schemas import IndexTables

EDGES = ("calls", "inherits", "imports", "defines")
#: Columns of every walk; `node` is the id that was asked for.
COLUMNS = ["node", "dir", "peer_id", "peer", "name", "fqn", "file", "l", "hint", "line", "conf", "rel"]


def _nodes(index: IndexTables) -> DataFrame:
    files = index.files.select("file_id", "rel_path")
    return index.nodes.join(files, "file_id").select(
        F.col("node_id").alias("peer_id"), ids.short_id(F.col("kind"), F.col("short_id")).alias("peer"), "name", "fqn",
        F.col("rel_path").alias("file"), F.col("start_line").alias("l"),
    )


def _files(index: IndexTables) -> DataFrame:
    return index.files.select(
        F.col("file_id").alias("peer_id"), F.concat(F.lit("f"), F.col("short_id").cast("string")).alias("peer"),
        F.regexp_extract("rel_path", r"([^/]*)$", 1).alias("name"), F.lit("").alias("fqn"), F.col("rel_path").alias("file"), F.lit(0).alias("l"),
    )


#: Walks whose rows stay where the other end is unknown; of the others such rows go.
OPEN = {("calls", "out"), ("inherits", "out"), ("imports", "out")}


def ends(index: IndexTables, edge: str, direction: str) -> DataFrame:
    """(node, peer_id, and what the edge itself shows) of one direction of an edge type."""
    none = {"hint": F.lit(""), "line": F.lit(0), "conf": F.lit(0), "rel": F.lit("")}

    def shown(rows: DataFrame, node: str, peer: str, **cols) -> DataFrame:
        if (edge, direction) not in OPEN:
            rows = rows.where(F.col(peer).isNotNull() & F.col(node).isNotNull())
        return rows.select(F.col(node).alias("node"), F.col(peer).alias("peer_id"), *[c.alias(n) for n, c in (none | cols).items()])

    if edge == "calls":
        cols = {"line": F.col("line"), "conf": F.col("confidence")}
        if direction == "out":
            hint = F.when(F.col("callee_id").isNull(), ids.prefixed(F.col("callee_owner"), F.col("callee_name"))).otherwise("")
            return shown(index.edges_calls, "caller_id", "callee_id", hint=hint, **cols)
        return shown(index.edges_calls, "callee_id", "caller_id", **cols)
    if edge == "inherits":
        if direction == "out":
            return shown(index.edges_inherits, "child_id", "parent_id", hint=F.col("parent_hint"), rel=F.col("relation"))
        return shown(index.edges_inherits, "parent_id", "child_id", rel=F.col("relation"))
    if edge == "imports":
        if direction == "out":
            return shown(index.edges_imports, "file_id", "target_file_id", hint=F.col("raw"))
        return shown(index.edges_imports, "target_file_id", "file_id", hint=F.col("raw"))
    if direction == "out":
        return shown(index.nodes, "owner_id", "node_id")
    return shown(index.nodes, "node_id", "owner_id")


def _check(edge: str, direction: str) -> None:
    if edge not in EDGES:
        raise ValueError(f"unknown edge {edge!r}; known are {', '.join(EDGES)}")
    if direction not in ("out", "in"):
        raise ValueError(f"unknown direction {direction!r}; known are in, out and both")


def _peers(index: IndexTables, edge: str) -> DataFrame:
    return _files(index) if edge == "imports" else _nodes(index)


def _alone(rows: DataFrame, peers: DataFrame) -> DataFrame:
    """Ends without a peer, with nulls for what it would show. They meet no join, whose null key would bring all of them into
    one task."""
    return rows.where("peer_id is null").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in peers.schema.fields if f.name != "peer_id"])


def walk_rows(index: IndexTables, edge: str, direction: str) -> DataFrame:
    """All rows of one direction (`out` or `in`) of an edge type. A snapshot has them sorted by node, both ways."""
    _check(edge, direction)
    if index.adjacency is not None:
        return index.adjacency.where((F.col("edge") == edge) & (F.col("dir") == direction)).select(*COLUMNS)
    rows, peers = ends(index, edge, direction), _peers(index, edge)
    if (edge, direction) in OPEN:
        out = rows.where("peer_id is not null").join(peers, "peer_id", "left").unionByName(_alone(rows, peers))
    else:
        out = rows.join(peers, "peer_id")
    return out.select(*[F.lit(direction).alias("dir") if c == "dir" else F.col(c) for c in COLUMNS])


def every_walk(index: IndexTables) -> DataFrame:
    """(edge, and the columns of a walk): all rows of all walks. The ends of all edges meet the nodes in one join, so
    these are moved once; ends without a peer meet nothing."""
    out = None
    for edges in (("calls", "inherits", "defines"), ("imports",)):
        rows = [ends(index, e, d).select(F.lit(e).alias("edge"), F.lit(d).alias("dir"), F.lit((e, d) in OPEN).alias("_open"), "*") for e in edges for d in ("out", "in")]
        rows, peers = functools.reduce(DataFrame.unionByName, rows), _peers(index, edges[0])
        met = rows.where("peer_id is not null").join(peers, "peer_id", "left").where("_open or peer is not null")
        both = met.unionByName(_alone(rows, peers)).select("edge", *COLUMNS)
        out = both if out is None else out.unionByName(both)
    return out


#: The order of each walk; all columns break ties, since edges are a multiset.
ORDER = {
    ("calls", "out"): ["line"], ("calls", "in"): ["fqn", "line"], ("inherits", "out"): ["hint"], ("inherits", "in"): ["fqn"],
    ("imports", "out"): ["hint"], ("imports", "in"): ["file"], ("defines", "out"): ["l"], ("defines", "in"): [],
}


def _order(edge: str, direction: str) -> list:
    first = ORDER[edge, direction]
    return [F.col(c).asc_nulls_last() for c in [*first, *[c for c in COLUMNS if c not in first]]]


def _directions(direction: str) -> list[str]:
    return ["out", "in"] if direction in ("", "both") else [direction]


def walk(index: IndexTables, of: str, edge: str, direction: str = "both", limit: int = 20, offset: int = 0) -> tuple[DataFrame, int]:
    """One page of each direction, and the number of rows on all pages. A negative offset counts as none."""
    limit, offset = limit if limit > 0 else 20, max(offset, 0)
    out, total = None, 0
    for d in _directions(direction):
        rows = walk_rows(index, edge, d).where(F.col("node") == of)
        total += rows.count()
        page = rows.orderBy(*_order(edge, d))
        page = page if (edge, d) == ("defines", "in") else page.offset(offset).limit(limit)
        out = page if out is None else out.unionByName(page)
    return out, total


def walk_many(index: IndexTables, nodes: DataFrame, edge: str, direction: str = "both", limit: int = 20, offset: int = 0) -> DataFrame:
    """Pages for a set of ids (column `node`): each direction of each id has its own page; `n` counts from 1."""
    limit, offset = limit if limit > 0 else 20, max(offset, 0)
    out = None
    for d in _directions(direction):
        rows = walk_rows(index, edge, d).join(nodes.select("node").distinct(), "node", "left_semi")
        n = F.row_number().over(Window.partitionBy("node").orderBy(*_order(edge, d)))
        page = rows.withColumn("n", n).where((F.col("n") > offset) & (F.col("n") <= offset + limit)).select(*COLUMNS, "n")
        out = page if out is None else out.unionByName(page)
    return out


def _counted(index: IndexTables, edge: str, direction: str) -> DataFrame:
    """(node, dir) of each row of a walk, without what it shows: peers are only asked whether they are there."""
    if index.adjacency is not None:
        return walk_rows(index, edge, direction).select("node", "dir")
    _check(edge, direction)
    rows = ends(index, edge, direction).select("node", "peer_id")
    if (edge, direction) not in OPEN:
        rows = rows.join(_peers(index, edge).select("peer_id"), "peer_id", "left_semi")
    return rows.select("node", F.lit(direction).alias("dir"))


def walk_totals(index: IndexTables, edge: str) -> DataFrame:
    """(node, n_out, n_in, total) of every id that has an edge."""
    rows = _counted(index, edge, "out").unionByName(_counted(index, edge, "in"))
    return rows.groupBy("node").agg(
        F.count_if(F.col("dir") == "out").alias("n_out"), F.count_if(F.col("dir") == "in").alias("n_in"), F.count(F.lit(1)).alias("total")
    )


def neighbors(index: IndexTables, start: DataFrame, depth: int, edges: DataFrame | None = None) -> DataFrame:
    """(node, hops): nodes within `depth` hops of the start ids (column `node`) along resolved edges, nearest first.

    Each round joins the frontier alone with the edges and takes off what was seen; rounds are checkpointed.
    """
    from .whole import graph_edges

    edges = cut(graph_edges(index).select("src", "dst").distinct()) if edges is None else edges
    seen = frontier = start.select("node").distinct().withColumn("hops", F.lit(0))
    for hop in range(1, depth + 1):
        near = frontier.select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node")).distinct()
        new = near.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(hop))
        frontier = cut(new)
        seen = seen.unionByName(frontier)
    return seen
