"""The queries over the driver tables, each with the SQL that an independent engine answers it by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import source_queries
from .functions import analyzer, ids
from .operators import lookups, search, walks, whole
from .plans import demo_views, resolve
from .sources.ignore import ignored

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


I, R = demo_views.index_ctes(), demo_views.raw_ctes()
idx, raw = demo_views.index_views, demo_views.raw_views

# ---- analyzer ---------------------------------------------------------------------------------------------------

_D = r"[/._\-: \t]"
_CUT = r"regexp_replace(regexp_replace({0}, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), '([^/._\-: \t])(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g')"
_STOPS = "[" + ", ".join(f"'{w}'" for w in analyzer.STOP_WORDS) + "]"
_STEM = (
    "CASE WHEN strlen(x) <= 3 THEN x "
    + " ".join(
        f"WHEN ends_with(x, '{a}') AND strlen(left(x, length(x) - {len(a)}) || '{b}') > 2 THEN left(x, length(x) - {len(a)}) || '{b}'"
        for a, b in analyzer.SUFFIXES
    )
    + " ELSE x END"
)


def _normal(text: str) -> str:
    parts = f"string_split_regex({_CUT.format(text)}, '{_D}+')"
    low = rf"list_transform({parts}, lambda x: lower(regexp_replace(x, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')))"
    kept = f"list_filter({low}, lambda x: strlen(x) >= 2 AND NOT list_contains({_STOPS}, x))"
    return f"list_filter(list_transform({kept}, lambda x: {_STEM}), lambda x: strlen(x) >= 2)"


@query(rf"SELECT doc_id, CAST(count(*) AS BIGINT) AS n_parts, CAST(count(DISTINCT part) AS BIGINT) AS n_distinct FROM (SELECT doc_id, unnest(string_split_regex(text, '{_D}')) AS part FROM documents) WHERE part <> '' GROUP BY doc_id")
def split_delimiters(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", analyzer.split_delimiters(F.col("text")).alias("parts"))
    repeated = docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again"))
    n = repeated.count()
    # a row is counted where it is; only the parts of ids with several rows are brought together
    once, own = docs, F.col("doc_id").eqNullSafe(F.col("again"))
    if n:
        repeated = F.broadcast(repeated) if n <= 100_000 else repeated
        once = docs.join(repeated, own, "left_anti")
    counts = once.select("doc_id", F.size("parts").cast("long").alias("n_parts"), F.size(F.array_distinct("parts")).cast("long").alias("n_distinct")).where("n_parts > 0")
    if not n:
        return counts
    parts = docs.join(repeated, own, "left_semi").select("doc_id", F.explode("parts").alias("part"))
    return counts.unionByName(parts.groupBy("doc_id").agg(F.count("part").alias("n_parts"), F.count_distinct("part").alias("n_distinct")))


@query(rf"SELECT s_suppkey, unnest(string_split(x, ' ')) AS part FROM (SELECT s_suppkey, {_CUT.format("replace(s_name, '#', 'Id') || 'aBCdEF'")} AS x FROM supplier)")
def split_camel(spark, sf_dir):
    name = F.concat(F.regexp_replace("s_name", "#", "Id"), F.lit("aBCdEF"))
    return _read(spark, sf_dir, "supplier").select("s_suppkey", F.explode(analyzer.split_camel(name)).alias("part"))


@query(rf"SELECT DISTINCT x AS word, {_STEM} AS stem FROM (SELECT lower(unnest(string_split_regex(text, '[^a-zA-Z]+'))) AS x FROM documents) WHERE x <> ''")
def stem(spark, sf_dir):
    words = _docs(spark, sf_dir).select(F.explode(F.split(F.col("text"), "[^a-zA-Z]+")).alias("w")).where("w <> ''").select(F.lower("w").alias("word")).distinct()
    return words.select("word", analyzer.stem(F.col("word")).alias("stem"))


@query(f"SELECT DISTINCT doc_id, unnest({_normal('text')}) AS token FROM documents")
def normalize_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(analyzer.normalize(F.col("text"))).alias("token"))


@query(
    f"SELECT p_partkey, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ' ') AS tokens "
    f"FROM (SELECT p_partkey, {_normal("p_name || ' ' || p_type || '/' || p_brand || '.getUserNames'")} AS t FROM part)"
)
def pre_tokenize(spark, sf_dir):
    text = F.concat("p_name", F.lit(" "), "p_type", F.lit("/"), "p_brand", F.lit(".getUserNames"))
    return _read(spark, sf_dir, "part").select("p_partkey", analyzer.pre_tokenize(text).alias("tokens"))


# ---- ids --------------------------------------------------------------------------------------------------------


@query("SELECT s_suppkey, 'f:' || s_name AS file_id FROM supplier")
def file_id(spark, sf_dir):
    return _read(spark, sf_dir, "supplier").select("s_suppkey", ids.file_id(F.col("s_name")).alias("file_id"))


@query("SELECT o_orderkey, 'n:java:' || CASE WHEN o_orderkey % 2 = 0 THEN 'o' ELSE 'm' END || ':' || o_orderpriority || ':' || o_orderstatus || ':' || o_custkey AS node_id FROM orders")
def node_id(spark, sf_dir):
    kind = F.when(F.col("o_orderkey") % 2 == 0, "object").otherwise("method")
    made = ids.node_id(F.lit("java"), kind, F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_custkey"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", made.alias("node_id"))


@query(f"{I} SELECT node_id, left(kind, 1) AS k, CASE kind WHEN 'object' THEN 'o' ELSE 'm' END || short_id AS id FROM nodes")
def short_id_format(spark, sf_dir):
    return idx(spark, sf_dir).nodes.select("node_id", F.substring("kind", 1, 1).alias("k"), ids.short_id(F.col("kind"), F.col("short_id")).alias("id"))


_CODES = "CASE c_custkey % 5 WHEN 0 THEN 'm' || c_custkey WHEN 1 THEN 'o' || c_custkey WHEN 2 THEN 'f' || c_custkey WHEN 3 THEN 'x' || c_custkey ELSE 'm' END"


@query(
    f"SELECT c_custkey, CASE WHEN ok THEN CASE left(t, 1) WHEN 'm' THEN 'method' WHEN 'o' THEN 'object' ELSE 'file' END END AS kind, "
    f"CASE WHEN ok THEN CAST(substr(t, 2) AS BIGINT) END AS num FROM (SELECT c_custkey, {_CODES} AS t, regexp_full_match({_CODES}, '[mof][0-9]+') AS ok FROM customer)"
)
def parse_short_id(spark, sf_dir):
    kind, num = ids.parse_short_id(F.expr(_CODES))
    return _read(spark, sf_dir, "customer").select("c_custkey", kind.alias("kind"), num.alias("num"))


@query(
    f"{I}, asked AS (SELECT CASE c_custkey % 4 WHEN 0 THEN 'o' || c_custkey WHEN 1 THEN 'm' || (1000000 + c_custkey) WHEN 2 THEN 'f' || c_custkey ELSE 'n:tpch:o:' || c_custkey END AS id FROM customer) "
    "SELECT id, node_id AS canonical_id, 'node' AS doc_kind FROM asked JOIN nodes ON id = CASE kind WHEN 'object' THEN 'o' ELSE 'm' END || short_id "
    "UNION ALL SELECT id, file_id, 'file' FROM asked JOIN files ON id = 'f' || short_id UNION ALL SELECT id, id, 'node' FROM asked WHERE id LIKE 'n:%'"
)
def resolve_id(spark, sf_dir):
    asked = _read(spark, sf_dir, "customer").select(
        F.expr("CASE c_custkey % 4 WHEN 0 THEN 'o' || c_custkey WHEN 1 THEN 'm' || (1000000 + c_custkey) WHEN 2 THEN 'f' || c_custkey ELSE 'n:tpch:o:' || c_custkey END AS id")
    )
    return lookups.resolve_ids(idx(spark, sf_dir), asked)


_PATHS = "CASE p_partkey % 3 WHEN 0 THEN 'src/' || p_brand || '/__init__.py' WHEN 1 THEN 'a/b/' || replace(p_type, ' ', '_') || '.py' ELSE '__init__.py' END"


@query(
    f"SELECT p_partkey, replace(CASE WHEN b = '__init__' THEN '' WHEN ends_with(b, '/__init__') THEN left(b, length(b) - 9) ELSE b END, '/', '.') AS module "
    f"FROM (SELECT p_partkey, left({_PATHS}, length({_PATHS}) - 3) AS b FROM part)"
)
def module_name(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", ids.module_name(F.expr(_PATHS)).alias("module"))


@query(f"{I} SELECT node_id, array_to_string(list_slice(string_split(fqn, '.'), 1, len(string_split(fqn, '.')) - 1), '.') AS head, string_split(fqn, '.')[-1] AS last FROM nodes")
def strip_last_segment(spark, sf_dir):
    return idx(spark, sf_dir).nodes.select("node_id", ids.strip_last(F.col("fqn")).alias("head"), ids.last_segment(F.col("fqn")).alias("last"))


_REL = "repeat('.', CAST(o_orderkey % 5 AS INT)) || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'x.y' || o_custkey END"


@query(
    f"WITH a AS (SELECT o_orderkey, {_REL} AS raw, CAST(o_orderkey % 5 AS INT) AS dots, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'x.y' || o_custkey END AS rest, "
    "CASE o_orderkey % 4 WHEN 0 THEN 'm' WHEN 1 THEN 'p.m' ELSE 'p.q.m' END AS module FROM orders), "
    "b AS (SELECT *, len(string_split(module, '.')) - 1 - (dots - 1) AS kept, "
    "array_to_string(list_slice(string_split(module, '.'), 1, greatest(len(string_split(module, '.')) - 1 - (dots - 1), 0)), '.') AS base FROM a) "
    "SELECT o_orderkey, raw, module, CASE WHEN dots = 0 OR kept < 0 OR (base = '' AND rest = '') THEN raw WHEN rest = '' THEN base WHEN base = '' THEN rest ELSE base || '.' || rest END AS absolute FROM b"
)
def relative_import(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.expr(f"{_REL} AS raw"), F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'm' WHEN 1 THEN 'p.m' ELSE 'p.q.m' END AS module"))
    return o.withColumn("absolute", ids.relative_import(F.col("raw"), F.col("module")))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'java' ELSE 'go' END AS lang FROM part")
def lang_from_ext(spark, sf_dir):
    path = F.concat("p_brand", F.expr("CASE p_partkey % 3 WHEN 0 THEN '.PY' WHEN 1 THEN '.java' ELSE '.go' END"))
    return _read(spark, sf_dir, "part").select("p_partkey", ids.lang_from_path(path).alias("lang"))


# ---- scan rules -------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.Java' ELSE '.txt' END AS ext FROM part WHERE p_partkey % 4 < 2")
def ext_filter(spark, sf_dir):
    from .sources.scan import has_extension

    p = _read(spark, sf_dir, "part").select("p_partkey", F.expr("CASE p_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.Java' ELSE '.txt' END AS ext"))
    return p.where(has_extension(F.concat(F.lit("a/b.c/x"), F.col("ext")), [".py", ".java"]))


_TREE = "CASE p_partkey % 6 WHEN 0 THEN 'target/x' || p_partkey WHEN 1 THEN 'a/target/x' || p_partkey WHEN 2 THEN 'a/__pycache__/m.py' WHEN 3 THEN 'pkg/module.pyc' WHEN 4 THEN 'src/gen' || p_size || '/a.py' ELSE 'src/a.py' END"


@query(
    f"SELECT p_partkey, path, (path LIKE 'target/%' OR path LIKE '%/\\_\\_pycache\\_\\_/%' ESCAPE '\\' OR path LIKE '%.pyc' OR regexp_matches(path, '^src/gen[^/]*/')) AS hidden "
    f"FROM (SELECT p_partkey, {_TREE} AS path FROM part)"
)
def ignore_match(spark, sf_dir):
    p = _read(spark, sf_dir, "part").select("p_partkey", F.expr(f"{_TREE} AS path"))
    return p.withColumn("hidden", ignored(F.col("path"), ["target/", "**/__pycache__/**", "*.pyc", "src/gen*"]))


# ---- search -----------------------------------------------------------------------------------------------------

_TERMS = r"list_filter(string_split_regex(lower(strip_accents({0})), '[^\p{{L}}\p{{N}}\p{{Co}}]+'), lambda x: x <> '')"
_POSTS = (
    f"{I}, terms AS (SELECT doc_id, doc_kind, 1 AS c, unnest({_TERMS.format('name')}) AS term FROM search_docs UNION ALL SELECT doc_id, doc_kind, 2, unnest({_TERMS.format('fqn')}) FROM search_docs "
    f"UNION ALL SELECT doc_id, doc_kind, 3, unnest({_TERMS.format('path')}) FROM search_docs), "
    "posts AS (SELECT term, doc_id, CAST(count(*) FILTER (c = 1) AS INT) AS tf_name, CAST(count(*) FILTER (c = 2) AS INT) AS tf_fqn, CAST(count(*) FILTER (c = 3) AS INT) AS tf_path FROM terms GROUP BY term, doc_id), "
    "stats AS (SELECT d.doc_id, d.doc_kind, CAST(count(t.term) AS INT) AS len FROM search_docs d LEFT JOIN terms t ON t.doc_id = d.doc_id GROUP BY d.doc_id, d.doc_kind)"
)


def _score_ctes(terms: list[str]) -> str:
    match = "CASE " + " ".join(f"WHEN term {'LIKE' if t.endswith('*') else '='} '{t.replace('*', '%')}' THEN {i}" for i, t in enumerate(terms)) + " END"
    return (
        f"{_POSTS}, hits AS (SELECT t, doc_id, sum(4.0 * tf_name + tf_fqn + tf_path)::DOUBLE AS f FROM (SELECT *, {match} AS t FROM posts) WHERE t IS NOT NULL GROUP BY t, doc_id), "
        "idf AS (SELECT t, CASE WHEN v <= 0 THEN 1e-6 ELSE v END AS idf FROM (SELECT t, ln(((SELECT count(*) FROM stats) - count(*) + 0.5) / (count(*) + 0.5)) AS v FROM hits GROUP BY t)), "
        "scored AS (SELECT s.doc_id, s.doc_kind, -sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / (SELECT avg(len) FROM stats)))) AS score "
        f"FROM hits JOIN idf USING (t) JOIN stats s USING (doc_id) GROUP BY s.doc_id, s.doc_kind HAVING count(*) = {len(terms)})"
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query(f"{_POSTS} SELECT * FROM posts")
def postings(spark, sf_dir):
    return search.postings(idx(spark, sf_dir).search_docs)


@query(f"{_POSTS} SELECT * FROM stats")
def doc_stats(spark, sf_dir):
    return search.doc_stats(idx(spark, sf_dir).search_docs)


@query(f"{_score_ctes(['the'])} SELECT doc_id, doc_kind, round(score, 6) AS score FROM scored")
def bm25_one_term(spark, sf_dir):
    return _rounded(search.bm25(idx(spark, sf_dir).search_docs, ["the"]))


@query(f"{_score_ctes(['der', 'schen'])} SELECT doc_id, doc_kind, round(score, 6) AS score FROM scored")
def bm25_and_terms(spark, sf_dir):
    return _rounded(search.bm25(idx(spark, sf_dir).search_docs, ["der", "schen"]))


@query(f"{_score_ctes(['tion', 'src0'])} SELECT doc_id, doc_kind, round(score, 6) AS score FROM scored ORDER BY scored.score, doc_id LIMIT 10")
def search_topk(spark, sf_dir):
    return _rounded(search.top_hits(search.bm25(idx(spark, sf_dir).search_docs, ["tion", "src0"]), 10))


@query(
    f"{_score_ctes(['the'])}, cut AS (SELECT * FROM scored ORDER BY score, doc_id LIMIT 20) "
    "SELECT doc_id, doc_kind, round(score, 6) AS score FROM cut WHERE doc_kind = 'file' ORDER BY cut.score, doc_id LIMIT 5"
)
def search_kind_filter(spark, sf_dir):
    return _rounded(search.top_hits(search.bm25(idx(spark, sf_dir).search_docs, ["the"]), 5, "file"))


@query(f"{_score_ctes(['th*', 'src1'])} SELECT doc_id, doc_kind, round(score, 6) AS score FROM scored")
def search_prefix(spark, sf_dir):
    return _rounded(search.bm25(idx(spark, sf_dir).search_docs, ["th*", "src1"]))


# ---- lookups ----------------------------------------------------------------------------------------------------


@query(
    f"{I} SELECT n.node_id, n.short_id, n.kind, n.subkind, n.name, n.fqn, n.owner_id, o.short_id AS owner_no, n.scope, n.signature, n.doc, n.start_line, n.end_line, "
    "n.file_id, f.short_id AS file_no, rel_path, lang FROM nodes n JOIN files f USING (file_id) LEFT JOIN nodes o ON o.node_id = n.owner_id"
)
def get_node(spark, sf_dir):
    return lookups.get_node(idx(spark, sf_dir))


@query(
    f"{I} SELECT n.node_id, (SELECT count(*) FROM nodes c WHERE c.owner_id = n.node_id) AS methods, (SELECT count(*) FROM edges_inherits e WHERE e.child_id = n.node_id AND relation = 'extends') AS extends, "
    "(SELECT count(*) FROM edges_inherits e WHERE e.child_id = n.node_id AND relation = 'implements') AS implements, (SELECT count(*) FROM edges_inherits e WHERE e.parent_id = n.node_id) AS extended_by "
    "FROM nodes n WHERE kind = 'object'"
)
def object_counts(spark, sf_dir):
    return lookups.object_counts(idx(spark, sf_dir))


@query(
    f"{I} SELECT n.node_id, (SELECT count(*) FROM edges_calls e WHERE e.caller_id = n.node_id) AS calls, (SELECT count(*) FROM edges_calls e WHERE e.callee_id = n.node_id) AS called_by, "
    "(SELECT count(*) FROM edges_calls e WHERE e.caller_id = n.node_id AND callee_id IS NULL) AS unresolved FROM nodes n WHERE kind = 'method'"
)
def method_counts(spark, sf_dir):
    return lookups.method_counts(idx(spark, sf_dir))


@query(f"{I} SELECT * FROM files WHERE rel_path IN (SELECT min(rel_path) FROM files)")
def get_file(spark, sf_dir):
    index = idx(spark, sf_dir)
    return lookups.get_file(index, index.files.agg(F.min("rel_path")).first()[0])


@query(f"{I} SELECT e.file_id, raw, f.short_id AS target_no FROM edges_imports e LEFT JOIN files f ON f.file_id = e.target_file_id")
def file_imports(spark, sf_dir):
    return lookups.file_imports(idx(spark, sf_dir))


@query(f"{I} SELECT file_id, node_id, short_id, subkind, name, start_line, end_line, (SELECT count(*) FROM nodes c WHERE c.owner_id = n.node_id) AS methods FROM nodes n WHERE kind = 'object'")
def file_objects(spark, sf_dir):
    return lookups.file_objects(idx(spark, sf_dir))


@query(f"{I} SELECT file_id, node_id, short_id, subkind, name, start_line, end_line FROM nodes WHERE kind = 'method' AND owner_id IS NULL")
def file_top_methods(spark, sf_dir):
    return lookups.file_top_methods(idx(spark, sf_dir))


@query(f"{I} SELECT node_id, n.short_id, kind, file_id, key, rel_path, start_line, end_line FROM nodes n JOIN files USING (file_id)")
def get_code_range(spark, sf_dir):
    return lookups.code_range(idx(spark, sf_dir))


@query(
    f"{I} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM nodes WHERE kind = 'object') AS objects, (SELECT count(*) FROM nodes WHERE kind = 'method') AS methods, "
    "(SELECT count(callee_id) FROM edges_calls) AS calls_resolved, (SELECT count(*) - count(callee_id) FROM edges_calls) AS calls_unresolved, (SELECT count(*) FROM edges_inherits) AS inherits, "
    "(SELECT count(target_file_id) FROM edges_imports) AS imports_resolved, (SELECT count(*) - count(target_file_id) FROM edges_imports) AS imports_external, (SELECT count(*) FROM search_docs) AS search_docs"
)
def stats(spark, sf_dir):
    return lookups.stats(idx(spark, sf_dir))


# ---- walks ------------------------------------------------------------------------------------------------------

_PEER = "CASE p.kind WHEN 'object' THEN 'o' ELSE 'm' END || p.short_id"
_WALKS = {
    ("calls", "out"): f"SELECT caller_id AS node, 'out' AS dir, callee_id AS peer_id, {_PEER} AS peer, p.name, p.fqn, f.rel_path AS file, p.start_line AS l, CASE WHEN callee_id IS NULL THEN CASE WHEN callee_owner = '' OR callee_name = '' THEN callee_name ELSE callee_owner || '.' || callee_name END ELSE '' END AS hint, line, confidence AS conf, '' AS rel FROM edges_calls LEFT JOIN nodes p ON p.node_id = callee_id LEFT JOIN files f ON f.file_id = p.file_id",
    ("calls", "in"): f"SELECT callee_id AS node, 'in' AS dir, caller_id AS peer_id, {_PEER} AS peer, p.name, p.fqn, f.rel_path AS file, p.start_line AS l, '' AS hint, line, confidence AS conf, '' AS rel FROM edges_calls JOIN nodes p ON p.node_id = caller_id JOIN files f ON f.file_id = p.file_id WHERE callee_id IS NOT NULL",
    ("inherits", "out"): f"SELECT child_id AS node, 'out' AS dir, parent_id AS peer_id, {_PEER} AS peer, p.name, p.fqn, f.rel_path AS file, p.start_line AS l, parent_hint AS hint, CAST(0 AS INT) AS line, CAST(0 AS INT) AS conf, relation AS rel FROM edges_inherits LEFT JOIN nodes p ON p.node_id = parent_id LEFT JOIN files f ON f.file_id = p.file_id",
    ("inherits", "in"): f"SELECT parent_id AS node, 'in' AS dir, child_id AS peer_id, {_PEER} AS peer, p.name, p.fqn, f.rel_path AS file, p.start_line AS l, '' AS hint, CAST(0 AS INT) AS line, CAST(0 AS INT) AS conf, relation AS rel FROM edges_inherits JOIN nodes p ON p.node_id = child_id JOIN files f ON f.file_id = p.file_id WHERE parent_id IS NOT NULL",
    ("imports", "out"): "SELECT e.file_id AS node, 'out' AS dir, target_file_id AS peer_id, 'f' || f.short_id AS peer, string_split(f.rel_path, '/')[-1] AS name, CASE WHEN f.file_id IS NULL THEN NULL ELSE '' END AS fqn, f.rel_path AS file, CASE WHEN f.file_id IS NOT NULL THEN CAST(0 AS INT) END AS l, raw AS hint, CAST(0 AS INT) AS line, CAST(0 AS INT) AS conf, '' AS rel FROM edges_imports e LEFT JOIN files f ON f.file_id = target_file_id",
    ("imports", "in"): "SELECT target_file_id AS node, 'in' AS dir, e.file_id AS peer_id, 'f' || f.short_id AS peer, string_split(f.rel_path, '/')[-1] AS name, '' AS fqn, f.rel_path AS file, CAST(0 AS INT) AS l, raw AS hint, CAST(0 AS INT) AS line, CAST(0 AS INT) AS conf, '' AS rel FROM edges_imports e JOIN files f ON f.file_id = e.file_id WHERE target_file_id IS NOT NULL",
    ("defines", "out"): f"SELECT p.owner_id AS node, 'out' AS dir, p.node_id AS peer_id, {_PEER} AS peer, p.name, p.fqn, f.rel_path AS file, p.start_line AS l, '' AS hint, CAST(0 AS INT) AS line, CAST(0 AS INT) AS conf, '' AS rel FROM nodes p JOIN files f ON f.file_id = p.file_id WHERE p.owner_id IS NOT NULL",
    ("defines", "in"): f"SELECT n.node_id AS node, 'in' AS dir, p.node_id AS peer_id, {_PEER} AS peer, p.name, p.fqn, f.rel_path AS file, p.start_line AS l, '' AS hint, CAST(0 AS INT) AS line, CAST(0 AS INT) AS conf, '' AS rel FROM nodes n JOIN nodes p ON p.node_id = n.owner_id JOIN files f ON f.file_id = p.file_id",
}


def _order_sql(edge: str, direction: str) -> str:
    first = walks.ORDER[edge, direction]
    return ", ".join(f"{c} NULLS LAST" for c in [*first, *[c for c in walks.COLUMNS if c not in first]])


def _walk_query(edge: str, direction: str) -> None:
    def run(spark, sf_dir):
        index = idx(spark, sf_dir)
        if direction == "both":
            return walks.walk_rows(index, edge, "out").unionByName(walks.walk_rows(index, edge, "in"))
        return walks.walk_rows(index, edge, direction)

    name = f"walk_{edge}_{direction}"
    QUERIES[name] = run
    parts = [_WALKS[edge, d] for d in (["out", "in"] if direction == "both" else [direction])]
    SQL[name] = f"{I} " + " UNION ALL ".join(parts)


for _e in walks.EDGES:
    for _d in ("out", "in", "both"):
        _walk_query(_e, _d)

_ONE = "n:tpch:m:10"


@query(
    f"{I}, o AS ({_WALKS['calls', 'out']}), i AS ({_WALKS['calls', 'in']}) (SELECT * FROM o WHERE node = '{_ONE}' ORDER BY {_order_sql('calls', 'out')} LIMIT 3 OFFSET 1) "
    f"UNION ALL (SELECT * FROM i WHERE node = '{_ONE}' ORDER BY {_order_sql('calls', 'in')} LIMIT 3 OFFSET 1)"
)
def walk_page(spark, sf_dir):
    return walks.walk(idx(spark, sf_dir), _ONE, "calls", "both", 3, 1)[0]


@query(
    f"{I}, o AS ({_WALKS['calls', 'out']}), i AS ({_WALKS['calls', 'in']}) SELECT node, count(*) FILTER (dir = 'out') AS n_out, count(*) FILTER (dir = 'in') AS n_in, count(*) AS total "
    "FROM (SELECT node, dir FROM o UNION ALL SELECT node, dir FROM i) GROUP BY node"
)
def walk_totals(spark, sf_dir):
    return walks.walk_totals(idx(spark, sf_dir), "calls")


@query(
    f"{I}, o AS ({_WALKS['calls', 'out']}), i AS ({_WALKS['calls', 'in']}), a AS (SELECT node_id FROM nodes WHERE kind = 'method'), "
    f"r AS (SELECT *, CAST(row_number() OVER (PARTITION BY node ORDER BY {_order_sql('calls', 'out')}) AS INT) AS n FROM o UNION ALL SELECT *, CAST(row_number() OVER (PARTITION BY node ORDER BY {_order_sql('calls', 'in')}) AS INT) AS n FROM i) "
    "SELECT * FROM r WHERE node IN (SELECT node_id FROM a) AND n > 1 AND n <= 3"
)
def walk_many(spark, sf_dir):
    index = idx(spark, sf_dir)
    return walks.walk_many(index, index.nodes.where("kind = 'method'").select(F.col("node_id").alias("node")), "calls", "both", 2, 1)


_EDGES = (
    "SELECT coalesce(owner_id, file_id) AS src, node_id AS dst, 'defines' AS t, '' AS rel FROM nodes UNION ALL SELECT caller_id, callee_id, 'calls', '' FROM edges_calls WHERE callee_id IS NOT NULL "
    "UNION ALL SELECT child_id, parent_id, 'inherits', relation FROM edges_inherits WHERE parent_id IS NOT NULL UNION ALL SELECT file_id, target_file_id, 'imports', '' FROM edges_imports WHERE target_file_id IS NOT NULL"
)


@query(
    f"{I}, edges AS (SELECT DISTINCT src, dst FROM ({_EDGES})), bfs(node, hops) AS (SELECT file_id, 0 FROM files UNION SELECT dst, hops + 1 FROM bfs JOIN edges ON src = node WHERE hops < 3) "
    "SELECT node, CAST(min(hops) AS INT) AS hops FROM bfs GROUP BY node"
)
def neighbors_bfs(spark, sf_dir):
    index = idx(spark, sf_dir)
    return walks.neighbors(index, index.files.select(F.col("file_id").alias("node")), 3)


# ---- whole index ------------------------------------------------------------------------------------------------


@query(
    f"{I} SELECT 'f' || f.short_id AS id, rel_path AS path, lang, package AS pkg, count(n.node_id) FILTER (n.kind = 'object') AS objects, count(n.node_id) FILTER (n.kind = 'method') AS methods "
    "FROM files f LEFT JOIN nodes n USING (file_id) GROUP BY ALL"
)
def tree(spark, sf_dir):
    return whole.tree(idx(spark, sf_dir))


@query(
    f"{I} SELECT 'f' || short_id AS id, 'file' AS k, string_split(rel_path, '/')[-1] AS name, rel_path AS path, lang, '' AS subk, CAST(0 AS INT) AS l, CAST(NULL AS VARCHAR) AS owner, CAST(NULL AS VARCHAR) AS file FROM files "
    "UNION ALL SELECT CASE n.kind WHEN 'object' THEN 'o' ELSE 'm' END || n.short_id, n.kind, n.name, rel_path, lang, n.subkind, n.start_line, CASE o.kind WHEN 'object' THEN 'o' ELSE 'm' END || o.short_id, 'f' || f.short_id "
    "FROM nodes n JOIN files f USING (file_id) LEFT JOIN nodes o ON o.node_id = n.owner_id"
)
def graph_nodes(spark, sf_dir):
    return whole.graph_nodes(idx(spark, sf_dir))


@query(f"{I} {_EDGES}")
def graph_edges(spark, sf_dir):
    return whole.graph_edges(idx(spark, sf_dir))


@query(
    f"{I}, ids AS (SELECT node_id, CASE kind WHEN 'object' THEN 'o' ELSE 'm' END || short_id AS sid FROM nodes UNION ALL SELECT file_id, 'f' || short_id FROM files), e AS ({_EDGES}) "
    'SELECT a.sid AS "from", b.sid AS "to", t, rel FROM e JOIN ids a ON a.node_id = src JOIN ids b ON b.node_id = dst'
)
def graph(spark, sf_dir):
    return whole.graph(idx(spark, sf_dir))[1]


@query(
    "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), greatest(s - 1, 1), s + 3), chr(10)) AS src FROM (SELECT doc_id, text, CAST(doc_id % 4 + 1 AS INT) AS s FROM documents)"
)
def code_lines(spark, sf_dir):
    start = (F.col("doc_id") % 4 + 1).cast("int")
    return _docs(spark, sf_dir).select("doc_id", whole.code_lines(F.col("text"), start, start + 2, 1).alias("src"))


# ---- resolution -------------------------------------------------------------------------------------------------

_MAPS = (
    f"{R}, ofqn AS (SELECT fqn, arg_max(node_id, short_id) AS id FROM r_objects GROUP BY fqn), mfqn AS (SELECT fqn, arg_max(node_id, short_id) AS id FROM r_methods GROUP BY fqn), "
    "own AS (SELECT owner_fqn, name, arg_max(node_id, short_id) AS id FROM r_methods WHERE owner_fqn <> '' GROUP BY ALL), fil AS (SELECT file_id, name, arg_max(node_id, short_id) AS id FROM r_methods GROUP BY ALL), "
    "um AS (SELECT name, min(node_id) AS id FROM r_methods GROUP BY name HAVING count(*) = 1), uo AS (SELECT name, min(node_id) AS id FROM r_objects GROUP BY name HAVING count(*) = 1), "
    "ali AS (SELECT file_id, alias, arg_max(raw, ord) AS target FROM r_imports WHERE alias <> '' GROUP BY ALL), vt AS (SELECT scope_fqn, var_name, arg_max(type_name, file_no * 10000000 + ord) AS t FROM r_vars GROUP BY ALL), "
    "c AS (SELECT *, array_to_string(list_slice(string_split(caller_fqn, '.'), 1, len(string_split(caller_fqn, '.')) - 1), '.') AS caller_owner FROM r_calls)"
)
_VAR = (
    "coalesce((SELECT t FROM vt WHERE scope_fqn = caller_fqn AND var_name = callee_owner), (SELECT t FROM vt WHERE scope_fqn = caller_owner AND caller_owner <> '' AND var_name = callee_owner), "
    "(SELECT t FROM vt WHERE scope_fqn = '' AND var_name = callee_owner))"
)
_P1 = (
    "CASE WHEN callee_owner = '' THEN coalesce((SELECT id FROM own WHERE owner_fqn = caller_owner AND caller_owner <> '' AND name = callee_name), (SELECT id FROM fil WHERE fil.file_id = c.file_id AND name = callee_name)) "
    "ELSE (SELECT arg_min(own.id, o.short_id) FROM r_objects o JOIN own ON own.owner_fqn = o.fqn WHERE o.file_id = c.file_id AND o.name = callee_owner AND own.name = callee_name) END"
)


def _p2(v: str) -> str:
    tries = [v, f"(SELECT target FROM ali WHERE ali.file_id = x.file_id AND alias = {v})", f"(SELECT target FROM ali WHERE ali.file_id = x.file_id AND alias = {v}) || '.' || {v}",
             "(SELECT target FROM ali WHERE ali.file_id = x.file_id AND alias = callee_owner)", "(SELECT target FROM ali WHERE ali.file_id = x.file_id AND alias = callee_owner) || '.' || callee_owner", "callee_owner"]
    return "CASE WHEN callee_owner <> '' THEN coalesce(" + ", ".join(f"(SELECT id FROM own WHERE owner_fqn = {t} AND name = callee_name)" for t in tries) + ") END"


_CALLS = (
    f"{_MAPS}, x AS (SELECT *, {_VAR} AS v FROM c), y AS (SELECT *, {_p2('v')} AS p2 FROM x), "
    f"z AS (SELECT file_id, ord, caller_fqn, callee_name, callee_owner, line, p2, v, {_P1.replace('c.file_id', 'y.file_id')} AS p1, (SELECT id FROM um WHERE name = callee_name) AS p3 FROM y)"
)


@query(f"{_MAPS} SELECT 'object' AS map, fqn AS key, id FROM ofqn UNION ALL SELECT 'method', fqn, id FROM mfqn UNION ALL SELECT 'owner', owner_fqn || '|' || name, id FROM own UNION ALL SELECT 'file', file_id || '|' || name, id FROM fil UNION ALL SELECT 'alias', file_id || '|' || alias, target FROM ali UNION ALL SELECT 'var', scope_fqn || '|' || var_name, t FROM vt")
def ix_last_wins(spark, sf_dir):
    r = raw(spark, sf_dir)
    pair = lambda a, b: F.concat(F.col(a), F.lit("|"), F.col(b))
    shape = lambda df, name, key, value: df.select(F.lit(name).alias("map"), key.alias("key"), F.col(value).alias("id"))
    return (
        shape(resolve.object_by_fqn(r), "object", F.col("fqn"), "object_id").unionByName(shape(resolve.method_by_fqn(r), "method", F.col("fqn"), "method_id"))
        .unionByName(shape(resolve.method_by_owner(r), "owner", pair("owner_fqn", "name"), "method_id")).unionByName(shape(resolve.method_by_file(r), "file", pair("file_id", "name"), "method_id"))
        .unionByName(shape(resolve.alias_map(r), "alias", pair("file_id", "alias"), "target")).unionByName(shape(resolve.var_type_map(r), "var", pair("scope_fqn", "var_name"), "type_name"))
    )


@query(f"{_MAPS} SELECT 'method' AS kind, name, id FROM um UNION ALL SELECT 'object', name, id FROM uo")
def ix_unique_name(spark, sf_dir):
    r = raw(spark, sf_dir)
    m, o = (resolve.unique_names(x, "id") for x in (r.methods, r.objects))
    return m.select(F.lit("method").alias("kind"), "name", "id").unionByName(o.select(F.lit("object").alias("kind"), "name", "id"))


@query(
    f"{R}, e AS (SELECT module AS name, file_id, file_no * 100000 AS pos, true AS sets FROM r_files WHERE lang = 'python' UNION ALL SELECT fqn, o.file_id, file_no * 100000 + ord * 2, true FROM r_objects o JOIN r_files f USING (file_id) WHERE lang = 'java' "
    "UNION ALL SELECT name, o.file_id, file_no * 100000 + ord * 2 + 1, false FROM r_objects o JOIN r_files f USING (file_id) WHERE lang = 'java') "
    "SELECT name, coalesce(arg_max(file_id, pos) FILTER (sets), arg_min(file_id, pos)) AS target_file_id FROM e GROUP BY name"
)
def ix_file_by_import(spark, sf_dir):
    return resolve.file_by_import(raw(spark, sf_dir))


@query(f"{_CALLS} SELECT ord, v AS var_type FROM x")
def var_lookup(spark, sf_dir):
    r = raw(spark, sf_dir)
    return resolve.var_lookup(r, r.calls).select("ord", "var_type")


@query(f"{_CALLS} SELECT ord, p1 FROM z")
def call_pass1(spark, sf_dir):
    r = raw(spark, sf_dir)
    return resolve.pass1(r, resolve.number_calls(r)).select("ord", "p1")


@query(f"{_CALLS} SELECT ord, p2 FROM z")
def call_pass2(spark, sf_dir):
    r = raw(spark, sf_dir)
    return resolve.pass2(r, resolve.number_calls(r)).select("ord", "p2")


@query(f"{_CALLS} SELECT ord, p3 FROM z")
def call_pass3(spark, sf_dir):
    r = raw(spark, sf_dir)
    return resolve.pass3(r, resolve.number_calls(r)).select("ord", "p3")


@query(
    f"{_CALLS} SELECT mfqn.id AS caller_id, coalesce(p1, p2, p3) AS callee_id, callee_name, callee_owner, line, CAST(CASE WHEN p1 IS NOT NULL THEN 100 WHEN p2 IS NOT NULL THEN 70 WHEN p3 IS NOT NULL THEN 40 ELSE 0 END AS INT) AS confidence "
    "FROM z JOIN mfqn ON mfqn.fqn = caller_fqn"
)
def resolve_call(spark, sf_dir):
    return resolve.resolve_calls(raw(spark, sf_dir))


@query(
    f"{_MAPS} SELECT child_id, coalesce((SELECT id FROM ofqn WHERE fqn = hint), (SELECT id FROM ofqn WHERE prefix <> '' AND fqn = prefix || '.' || hint), "
    "(SELECT id FROM ofqn WHERE fqn = (SELECT target FROM ali WHERE ali.file_id = b.file_id AND alias = hint)), (SELECT id FROM uo WHERE name = hint)) AS parent_id, hint AS parent_hint, relation FROM r_bases b"
)
def resolve_inherit(spark, sf_dir):
    return resolve.resolve_inherits(raw(spark, sf_dir))


@query(
    f"{R}, e AS (SELECT module AS name, file_id, file_no * 100000 AS pos, true AS sets FROM r_files WHERE lang = 'python' UNION ALL SELECT fqn, o.file_id, file_no * 100000 + ord * 2, true FROM r_objects o JOIN r_files f USING (file_id) WHERE lang = 'java' "
    "UNION ALL SELECT name, o.file_id, file_no * 100000 + ord * 2 + 1, false FROM r_objects o JOIN r_files f USING (file_id) WHERE lang = 'java'), "
    "t AS (SELECT name, coalesce(arg_max(file_id, pos) FILTER (sets), arg_min(file_id, pos)) AS target FROM e GROUP BY name) SELECT i.file_id, target AS target_file_id, raw FROM (SELECT DISTINCT file_id, raw FROM r_imports) i LEFT JOIN t ON t.name = raw"
)
def import_edges(spark, sf_dir):
    return resolve.resolve_imports(raw(spark, sf_dir))


@query(f"{_MAPS} SELECT node_id, (SELECT id FROM ofqn WHERE ofqn.fqn = array_to_string(list_slice(string_split(o.fqn, '.'), 1, len(string_split(o.fqn, '.')) - 1), '.')) AS owner_id FROM r_objects o")
def nested_owner(spark, sf_dir):
    return resolve.nested_owners(raw(spark, sf_dir))


@query(f"{_MAPS} SELECT node_id, (SELECT id FROM ofqn WHERE ofqn.fqn = m.owner_fqn) AS owner_id FROM r_methods m")
def method_owner(spark, sf_dir):
    return resolve.method_owners(raw(spark, sf_dir))


# ---- sources, extractors, raw tables and sinks ------------------------------------------------------------------

QUERIES |= source_queries.QUERIES | {"build_search_docs": source_queries.build_search_docs}
SQL |= source_queries.SQL | {"build_search_docs": source_queries.search_docs_sql(_normal)}


def _written(spark, sf_dir, result, *also, shown=""):
    return source_queries.stored(spark, [idx(spark, sf_dir)], result, also, shown)


@query(SQL["bm25_and_terms"])
def search_stored(spark, sf_dir):
    """The same hits from the postings and statistics of a written snapshot."""
    hits = lambda index: _rounded(search.bm25(index.search_docs, ["der", "schen"], index.postings, index.doc_stats))
    return _written(spark, sf_dir, hits, "search")


@query(SQL["search_topk"])
def search_topk_stored(spark, sf_dir):
    """The best hits from the blocks of postings whose bounds reach them."""
    hits = lambda index: _rounded(search.top_hits(search.BlockSearch(index, ["tion", "src0"], 10).scored(), 10))
    return _written(spark, sf_dir, hits, "search")


@query(f"{I} " + " UNION ALL ".join(f"SELECT '{e}' AS edge, {', '.join(walks.COLUMNS)} FROM ({sql})" for (e, _), sql in _WALKS.items()))
def walks_stored(spark, sf_dir):
    """All walks in both directions, from the adjacency of a written snapshot."""
    return _written(spark, sf_dir, lambda index: index.adjacency.select("edge", *walks.COLUMNS), "lookups", shown="adjacency")


@query(
    f"SELECT node_id AS id, methods + extends * 1000 + implements * 100000 + extended_by * 10000000 AS counts FROM ({SQL['object_counts']}) "
    f"UNION ALL SELECT node_id, calls + called_by * 1000 + unresolved * 1000000 FROM ({SQL['method_counts']}) UNION ALL SELECT path, objects + methods * 1000000 FROM ({SQL['tree']})"
)
def counts_stored(spark, sf_dir):
    """The counts that a written snapshot keeps of objects, methods and files, each set as one number."""
    def rows(index):
        o = lookups.object_counts(index).select(F.col("node_id").alias("id"), F.expr("methods + extends * 1000 + implements * 100000 + extended_by * 10000000").alias("counts"))
        m = lookups.method_counts(index).select(F.col("node_id").alias("id"), F.expr("calls + called_by * 1000 + unresolved * 1000000").alias("counts"))
        f = whole.tree(index).select(F.col("path").alias("id"), F.expr("objects + methods * 1000000").alias("counts"))
        return o.unionByName(m).unionByName(f)

    return _written(spark, sf_dir, rows, "lookups")


@query(SQL["resolve_id"])
def resolve_id_stored(spark, sf_dir):
    """Short ids by the sorted ids of a written snapshot."""
    asked = _read(spark, sf_dir, "customer").select(
        F.expr("CASE c_custkey % 4 WHEN 0 THEN 'o' || c_custkey WHEN 1 THEN 'm' || (1000000 + c_custkey) WHEN 2 THEN 'f' || c_custkey ELSE 'n:tpch:o:' || c_custkey END AS id")
    )
    return _written(spark, sf_dir, lambda index: lookups.resolve_ids(index, asked), "lookups")
