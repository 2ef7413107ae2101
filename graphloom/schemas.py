"""Types of the index tables, and the bundle that query operators take."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

FILES = "file_id string, short_id long, key string, rel_path string, lang string, package string, hash string"
NODES = (
    "node_id string, short_id long, file_id string, kind string, subkind string, name string, fqn string, owner_id string, "
    "scope string, signature string, doc string, start_line int, end_line int"
)
EDGES_CALLS = "caller_id string, callee_id string, callee_name string, callee_owner string, line int, confidence int"
EDGES_INHERITS = "child_id string, parent_id string, parent_hint string, relation string"
EDGES_IMPORTS = "file_id string, target_file_id string, raw string"
SEARCH_DOCS = "doc_id string, doc_kind string, name string, fqn string, path string"
POSTINGS = "term string, doc_id string, doc_kind string, block long, len int, tf_name int, tf_fqn int, tf_path int"
DOC_STATS = "doc_id string, doc_kind string, len int, block long"
POSTING_BLOCKS = "term string, block long, n long, max_f double, min_len int"
SEARCH_STATS = "n_docs long, total_len long"
ADJACENCY = (
    "edge string, dir string, node string, peer_id string, peer string, name string, fqn string, file string, l int, hint string, line int, "
    "conf int, rel string"
)
IDS = "kind string, short_id long, canonical_id string"
NODE_COUNTS = "node_id string, methods long, extends long, implements long, extended_by long, calls long, called_by long, unresolved long"
FILE_COUNTS = "file_id string, id string, path string, lang string, pkg string, objects long, methods long, imports long"
NODES_OF_FILE = (
    "file_id string, node_id string, short_id long, kind string, subkind string, name string, owner_id string, start_line int, end_line int, methods long"
)
TOTALS = (
    "files long, objects long, methods long, calls_resolved long, calls_unresolved long, inherits long, imports_resolved long, "
    "imports_external long, search_docs long"
)

#: One row per parsed file, as the extractors leave it.
PARSED = (
    "package string, imports array<struct<raw:string,alias:string>>, "
    "objects array<struct<name:string,fqn:string,subkind:string,bases:array<struct<name:string,relation:string>>,doc:string,start_line:int,end_line:int>>, "
    "methods array<struct<name:string,fqn:string,owner_fqn:string,subkind:string,scope:string,signature:string,doc:string,start_line:int,end_line:int>>, "
    "calls array<struct<caller_fqn:string,callee_name:string,callee_owner:string,line:int>>, "
    "var_types array<struct<scope_fqn:string,var_name:string,type_name:string>>"
)

TABLES = {
    "files": FILES, "nodes": NODES, "edges_calls": EDGES_CALLS, "edges_inherits": EDGES_INHERITS,
    "edges_imports": EDGES_IMPORTS, "search_docs": SEARCH_DOCS,
}
#: The files of a snapshot as they were parsed, and edges with the place of their call or base: what the next sync starts from.
PARSED_FILES = f"key string, rel_path string, lang string, size long, modified long, hash string, error boolean, {PARSED}"
KEYED = {"edges_calls": f"{EDGES_CALLS}, file_id string, ord int", "edges_inherits": f"{EDGES_INHERITS}, file_id string, ord int"}
#: What a snapshot keeps for the search.
SEARCH = {"postings": POSTINGS, "doc_stats": DOC_STATS, "posting_blocks": POSTING_BLOCKS, "search_stats": SEARCH_STATS}
#: What it keeps for lookups, walks and counts.
STORED = {
    "adjacency": ADJACENCY, "ids": IDS, "node_counts": NODE_COUNTS, "file_counts": FILE_COUNTS, "nodes_of_file": NODES_OF_FILE, "totals": TOTALS,
}


@dataclass(frozen=True)
class IndexTables:
    files: DataFrame
    nodes: DataFrame
    edges_calls: DataFrame
    edges_inherits: DataFrame
    edges_imports: DataFrame
    search_docs: DataFrame
    #: What search and lookups read in a snapshot; where an index has not been stored, they go without.
    postings: DataFrame | None = None
    doc_stats: DataFrame | None = None
    posting_blocks: DataFrame | None = None
    search_stats: DataFrame | None = None
    adjacency: DataFrame | None = None
    ids: DataFrame | None = None
    node_counts: DataFrame | None = None
    file_counts: DataFrame | None = None
    nodes_of_file: DataFrame | None = None
    totals: DataFrame | None = None

    @classmethod
    def read(cls, spark: SparkSession, path: str, also: tuple[str, ...] = ("search", "lookups"), stored: bool = True) -> IndexTables:
        """The tables of a snapshot, with what it keeps beside them for the search and for lookups; without `stored` the tables alone."""
        also = also if stored else ()
        every = TABLES | (SEARCH if "search" in also else {}) | (STORED if "lookups" in also else {})
        return cls(**{name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in every.items()})

    def delete_file(self, file_id: str) -> IndexTables:
        """Without one file: its nodes and edges go, references to them become null. What was kept for lookups is left out, as it
        tells of the whole; the counts of the search stay those of the whole."""
        gone = self.nodes.where(self.nodes.file_id == file_id).select("node_id")

        def without(edges: DataFrame, col: str) -> DataFrame:
            return edges.join(gone.withColumnRenamed("node_id", col), col, "left_anti").select(*edges.columns)

        def nulled(rows: DataFrame, col: str) -> DataFrame:
            from pyspark.sql import functions as F

            mark = gone.select(F.col("node_id").alias("_gone"))
            out = rows.join(mark, F.col(col) == F.col("_gone"), "left")
            return out.withColumn(col, F.when(F.col("_gone").isNull(), F.col(col))).select(*rows.columns)

        from pyspark.sql import functions as F

        def of_docs(rows: DataFrame | None) -> DataFrame | None:
            mark = gone.withColumnRenamed("node_id", "doc_id")
            return rows and rows.where(F.col("doc_id") != file_id).join(mark, "doc_id", "left_anti").select(*rows.columns)

        docs = self.search_docs.where(F.col("doc_id") != file_id)
        return IndexTables(
            files=self.files.where(F.col("file_id") != file_id),
            nodes=nulled(self.nodes.where(F.col("file_id") != file_id), "owner_id"),
            edges_calls=nulled(without(self.edges_calls, "caller_id"), "callee_id"),
            edges_inherits=nulled(without(self.edges_inherits, "child_id"), "parent_id"),
            edges_imports=self.edges_imports.where(F.col("file_id") != file_id).withColumn(
                "target_file_id", F.when(F.col("target_file_id") != file_id, F.col("target_file_id"))
            ),
            search_docs=docs.join(gone.withColumnRenamed("node_id", "doc_id"), "doc_id", "left_anti").select(*docs.columns),
            postings=of_docs(self.postings),
            doc_stats=of_docs(self.doc_stats),
        )
