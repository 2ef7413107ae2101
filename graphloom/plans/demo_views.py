"""Index-shaped and raw-shaped views over the TPC-H-like tables, so that the operators run on data of any size.

The views are written in SQL that Spark and DuckDB both read; what is compared between them are the operators on top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import IndexTables
from .raw import RawTables

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents")

INDEX_VIEWS = {
    "files": """
        SELECT 'f:' || n_name AS file_id, CAST(n_nationkey + 1 AS BIGINT) AS short_id, n_name AS key, r_name || '/' || n_name AS rel_path,
               r_name AS lang, lower(r_name) AS package, '' AS hash
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "nodes": """
        SELECT 'n:tpch:o:' || CAST(c_custkey AS STRING) AS node_id, CAST(c_custkey AS BIGINT) AS short_id, 'f:' || n_name AS file_id,
               'object' AS kind, 'class' AS subkind, c_name AS name, c_mktsegment || '.' || c_name AS fqn, CAST(NULL AS STRING) AS owner_id,
               'global' AS scope, '' AS signature, '' AS doc, CAST(c_custkey AS INT) AS start_line, CAST(c_custkey + 10 AS INT) AS end_line
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL
        SELECT 'n:tpch:m:' || CAST(o_orderkey AS STRING), CAST(1000000 + o_orderkey AS BIGINT), 'f:' || n_name,
               'method', CASE WHEN o_orderkey % 7 = 0 THEN 'fn' ELSE 'method' END, o_orderpriority, c_name || '.o' || CAST(o_orderkey AS STRING),
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'n:tpch:o:' || CAST(c_custkey AS STRING) END,
               CASE WHEN o_orderkey % 7 = 0 THEN 'global' ELSE 'member' END, o_orderstatus, '', CAST(o_orderkey % 1000 + 1 AS INT), CAST(o_orderkey % 1000 + 9 AS INT)
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "edges_calls": """
        SELECT 'n:tpch:m:' || CAST(l_orderkey AS STRING) AS caller_id, 'n:tpch:m:' || CAST(o_orderkey AS STRING) AS callee_id,
               coalesce(p_name, '') AS callee_name, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS callee_owner, CAST(l_linenumber AS INT) AS line,
               CAST(CASE WHEN o_orderkey IS NULL THEN 0 WHEN l_partkey % 3 = 0 THEN 100 WHEN l_partkey % 3 = 1 THEN 70 ELSE 40 END AS INT) AS confidence
        FROM lineitem LEFT JOIN orders ON o_orderkey = l_partkey * 10 LEFT JOIN part ON p_partkey = l_partkey""",
    "edges_inherits": """
        SELECT 'n:tpch:o:' || CAST(s_suppkey AS STRING) AS child_id,
               CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'n:tpch:o:' || CAST(s_nationkey + 1 AS STRING) END AS parent_id,
               s_name AS parent_hint, CASE WHEN s_suppkey % 2 = 0 THEN 'extends' ELSE 'implements' END AS relation
        FROM supplier""",
    "edges_imports": """
        SELECT 'f:' || a.n_name AS file_id, CASE WHEN a.n_nationkey % 4 = 0 THEN NULL ELSE 'f:' || b.n_name END AS target_file_id,
               r_name || '.' || a.n_name AS raw
        FROM nation a JOIN region ON a.n_regionkey = r_regionkey JOIN nation b ON b.n_nationkey = a.n_regionkey * 5""",
    "search_docs": """
        SELECT 'd' || CAST(doc_id AS STRING) AS doc_id, CASE WHEN doc_id % 3 = 0 THEN 'file' ELSE 'node' END AS doc_kind,
               source AS name, lang AS fqn, text AS path
        FROM documents""",
}

RAW_VIEWS = {
    "r_files": """
        SELECT 'f:' || n_name AS file_id, CAST(n_nationkey + 1 AS BIGINT) AS file_no, n_name AS key, r_name || '/' || n_name AS rel_path,
               CASE WHEN n_nationkey % 2 = 0 THEN 'python' ELSE 'java' END AS lang, '' AS package, lower(r_name) || '.' || lower(n_name) AS module,
               CASE WHEN n_nationkey % 2 = 0 THEN lower(r_name) || '.' || lower(n_name) ELSE '' END AS prefix
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "r_objects": """
        SELECT 'o:' || CAST(s_suppkey AS STRING) AS node_id, CAST(s_suppkey AS BIGINT) AS short_id, file_id, CAST(s_suppkey AS INT) AS ord,
               'C' || CAST(s_suppkey % 40 AS STRING) AS name, CASE WHEN s_suppkey % 10 = 3 THEN module || '.C' || CAST((s_suppkey + 1) % 40 AS STRING) ELSE module END || '.C' || CAST(s_suppkey % 40 AS STRING) AS fqn
        FROM supplier JOIN r_files ON s_nationkey + 1 = file_no""",
    "r_methods": """
        SELECT 'm:' || CAST(p_partkey AS STRING) AS node_id, CAST(100000 + p_partkey AS BIGINT) AS short_id, coalesce(r_objects.file_id, r_files.file_id) AS file_id,
               CASE WHEN p_partkey % 17 = 0 THEN 'u' || CAST(p_partkey AS STRING) ELSE 'm' || CAST(p_partkey % 300 AS STRING) END AS name,
               coalesce(r_objects.fqn, module) || CASE WHEN p_partkey % 17 = 0 THEN '.u' || CAST(p_partkey AS STRING) ELSE '.m' || CAST(p_partkey % 300 AS STRING) END AS fqn, coalesce(r_objects.fqn, '') AS owner_fqn
        FROM part LEFT JOIN r_objects ON r_objects.short_id = p_partkey % 130 JOIN r_files ON file_no = p_partkey % 25 + 1""",
    "r_calls": """
        SELECT coalesce(r_methods.file_id, 'f:none') AS file_id, CAST(o_orderkey AS INT) AS ord, coalesce(r_methods.fqn, 'missing.x') AS caller_fqn,
               CASE WHEN o_orderkey % 13 = 0 THEN 'u' || CAST(o_custkey % 130 * 17 AS STRING) ELSE 'm' || CAST(o_custkey % 400 AS STRING) END AS callee_name,
               CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'C' || CAST(o_custkey % 40 AS STRING) WHEN 3 THEN 'v' || CAST(o_orderkey % 20 AS STRING)
                    WHEN 4 THEN 'A' || CAST(o_custkey % 15 AS STRING) ELSE coalesce(r_objects.fqn, 'v1') END AS callee_owner, CAST(o_orderkey % 500 AS INT) AS line
        FROM orders LEFT JOIN r_methods ON r_methods.short_id = 100000 + o_orderkey % 2100 LEFT JOIN r_objects ON r_objects.short_id = o_custkey % 100 + 1""",
    "r_imports": """
        SELECT r_files.file_id, CAST(o_orderkey AS INT) AS ord, CASE WHEN o_orderkey % 3 = 0 THEN coalesce(t.module, 'ext') ELSE coalesce(r_objects.fqn, 'os.path') END AS raw,
               CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN 'C' || CAST(o_orderkey % 40 AS STRING) ELSE 'A' || CAST(o_orderkey % 15 AS STRING) END AS alias
        FROM orders JOIN r_files ON file_no = o_orderkey % 25 + 1 LEFT JOIN r_objects ON r_objects.short_id = o_custkey % 120 + 1
        LEFT JOIN r_files t ON t.file_no = o_custkey % 30 + 1""",
    "r_vars": """
        SELECT CAST(c_nationkey + 1 AS BIGINT) AS file_no, CAST(c_custkey AS INT) AS ord,
               CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN coalesce(r_objects.fqn, '') ELSE coalesce(r_methods.fqn, 'x') END AS scope_fqn,
               'v' || CAST(c_custkey % 20 AS STRING) AS var_name,
               CASE WHEN c_custkey % 3 = 0 THEN coalesce(o2.fqn, 'int') ELSE 'C' || CAST(c_custkey % 40 AS STRING) END AS type_name
        FROM customer LEFT JOIN r_objects ON r_objects.short_id = c_custkey % 100 LEFT JOIN r_methods ON r_methods.short_id = 100000 + c_custkey
        LEFT JOIN r_objects o2 ON o2.short_id = c_custkey % 90 + 1""",
    "r_bases": """
        SELECT r_objects.node_id AS child_id, r_objects.file_id, r_files.prefix, CAST(0 AS INT) AS ord,
               CASE r_objects.short_id % 5 WHEN 0 THEN coalesce(o2.fqn, 'Base') WHEN 1 THEN coalesce(o2.name, 'Base') WHEN 2 THEN 'A' || CAST(r_objects.short_id % 15 AS STRING)
                    WHEN 3 THEN 'C' || CAST(r_objects.short_id % 40 AS STRING) ELSE 'Nowhere' END AS hint,
               CASE WHEN r_objects.short_id % 2 = 0 THEN 'extends' ELSE 'implements' END AS relation
        FROM r_objects JOIN r_files ON r_files.file_id = r_objects.file_id LEFT JOIN r_objects o2 ON o2.short_id = (r_objects.short_id * 7) % 100""",
}


def _views(spark: SparkSession, sf_dir: str, views: dict[str, str]) -> dict[str, DataFrame]:
    """The views as data frames; names in the SQL stand for tables and for views before them."""
    import re

    have: dict[str, DataFrame] = {}
    for name, sql in views.items():
        words = set(re.findall(r"\b(?:FROM|JOIN) (\w+)", sql))
        for w in words:
            if w in BASE and w not in have:
                have[w] = spark.read.parquet(f"{sf_dir}/{w}.parquet")
        text = re.sub(r"\b(FROM|JOIN) (\w+)", lambda m: f"{m[1]} {{{m[2]}}} " + ("" if _aliased(sql, m.end()) else m[2]), sql)
        have[name] = spark.sql(text, **{w: have[w] for w in words})
    return have


def _aliased(sql: str, at: int) -> bool:
    """True if an alias follows the table name that ends at `at`."""
    import re

    m = re.match(r"\s+(\w+)", sql[at:])
    return bool(m) and m[1].upper() not in ("ON", "JOIN", "LEFT", "WHERE", "UNION", "GROUP", "ORDER")


def index_views(spark: SparkSession, sf_dir: str) -> IndexTables:
    v = _views(spark, sf_dir, INDEX_VIEWS)
    return IndexTables(**{name: v[name] for name in INDEX_VIEWS})


def raw_views(spark: SparkSession, sf_dir: str) -> RawTables:
    v = _views(spark, sf_dir, RAW_VIEWS)
    return RawTables(files=v["r_files"], objects=v["r_objects"], methods=v["r_methods"], bases=v["r_bases"], calls=v["r_calls"], imports=v["r_imports"], var_types=v["r_vars"])


def index_ctes() -> str:
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({sql})" for n, sql in INDEX_VIEWS.items())


def raw_ctes() -> str:
    return "WITH " + ", ".join(f"{n} AS ({sql})" for n, sql in RAW_VIEWS.items())
