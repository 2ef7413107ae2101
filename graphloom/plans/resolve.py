"""References resolved by cascades of left joins.

Maps of which the last (or first) entry wins are aggregations by explicit places. Names count for the last pass only
where they are unique, and that is settled before the join, so common names never meet each other in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import ids
from ..functions.analyzer import pre_tokenize
from ..schemas import IndexTables
from .raw import RawTables


def last_wins(rows: DataFrame, keys: list[str], value: str, place: Column, name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, place).alias(name))


def object_by_fqn(raw: RawTables) -> DataFrame:
    return last_wins(raw.objects, ["fqn"], "node_id", F.col("short_id"), "object_id")


def method_by_fqn(raw: RawTables) -> DataFrame:
    return last_wins(raw.methods, ["fqn"], "node_id", F.col("short_id"), "method_id")


def unique_names(nodes: DataFrame, name: str = "unique_id") -> DataFrame:
    found = nodes.groupBy("name").agg(F.count(F.lit(1)).alias("_n"), F.min("node_id").alias(name))
    return found.where("_n = 1").drop("_n")


def method_by_owner(raw: RawTables) -> DataFrame:
    return last_wins(raw.methods.where("owner_fqn <> ''"), ["owner_fqn", "name"], "node_id", F.col("short_id"), "method_id")


def method_by_file(raw: RawTables) -> DataFrame:
    return last_wins(raw.methods, ["file_id", "name"], "node_id", F.col("short_id"), "method_id")


def alias_map(raw: RawTables) -> DataFrame:
    return last_wins(raw.imports.where("alias <> ''"), ["file_id", "alias"], "raw", F.col("ord"), "target")


def var_type_map(raw: RawTables) -> DataFrame:
    return last_wins(raw.var_types, ["scope_fqn", "var_name"], "type_name", F.struct("file_no", "ord"), "type_name")


def file_by_import(raw: RawTables) -> DataFrame:
    """(name, target_file_id): modules and object names; a name that is set keeps others' simple names out."""
    files = raw.files.select("file_id", "file_no", "lang", "module")
    modules = files.where("lang = 'python'").select(F.col("module").alias("name"), "file_id", F.struct("file_no", F.lit(0).alias("o"), F.lit(0).alias("k")).alias("at"), F.lit(True).alias("sets"))
    java = raw.objects.join(files.where("lang = 'java'").select("file_id", "file_no"), "file_id")
    full = java.select(F.col("fqn").alias("name"), "file_id", F.struct("file_no", F.col("ord").alias("o"), F.lit(0).alias("k")).alias("at"), F.lit(True).alias("sets"))
    simple = java.select("name", "file_id", F.struct("file_no", F.col("ord").alias("o"), F.lit(1).alias("k")).alias("at"), F.lit(False).alias("sets"))
    every = modules.unionByName(full).unionByName(simple)
    # a setter always overwrites; a simple name counts only as the very first entry of its key
    picked = every.groupBy("name").agg(
        F.max_by("file_id", F.when(F.col("sets"), F.col("at"))).alias("_set"),
        F.min_by("file_id", "at").alias("_first"),
    )
    return picked.select("name", F.coalesce("_set", "_first").alias("target_file_id"))


def var_lookup(raw: RawTables, calls: DataFrame) -> DataFrame:
    """Adds var_type: the type of callee_owner in the caller's scope, else its owner's, else the service's."""
    types = var_type_map(raw)
    at = lambda n: types.select(F.col("scope_fqn").alias(f"_s{n}"), F.col("var_name").alias("callee_owner"), F.col("type_name").alias(f"_t{n}"))
    out = calls.withColumn("_s1", F.col("caller_fqn")).join(at(1), ["_s1", "callee_owner"], "left")
    owner = ids.strip_last(F.col("caller_fqn"))
    out = out.withColumn("_s2", F.when(owner != "", owner)).join(at(2), ["_s2", "callee_owner"], "left")
    out = out.join(at(3).where("_s3 = ''").drop("_s3"), "callee_owner", "left")
    return out.withColumn("var_type", F.coalesce("_t1", "_t2", "_t3")).drop("_s1", "_s2", "_t1", "_t2", "_t3")


#: Calls with an owner; a null one counts as none.
OWNED = "coalesce(callee_owner, '') <> ''"


def pass1(raw: RawTables, calls: DataFrame) -> DataFrame:
    """Adds p1: in the same file. calls has call_no, unique for each call.

    Bare calls and calls with an owner take joins of their own, and of the bare ones only those in an owner look for its
    methods, so no row meets a join under a null key.
    """
    by_owner = method_by_owner(raw).withColumnRenamed("name", "callee_name")
    owner, none = ids.strip_last(F.col("caller_fqn")), F.lit(None).cast("string")
    bare = calls.where(f"not {OWNED}").withColumn("owner_fqn", owner)
    inside = bare.where("owner_fqn <> ''").join(by_owner.withColumnRenamed("method_id", "_own"), ["owner_fqn", "callee_name"], "left")
    bare = inside.unionByName(bare.where("owner_fqn = ''").withColumn("_own", none)).drop("owner_fqn")
    by_file = method_by_file(raw).withColumnsRenamed({"name": "callee_name", "method_id": "_file"})
    bare = bare.join(by_file, ["file_id", "callee_name"], "left").withColumn("p1", F.coalesce("_own", "_file")).drop("_own", "_file")
    # an owner that is the simple name of objects of this file: the first of them that has the method
    owned = calls.where(OWNED)
    objects = raw.objects.select("file_id", F.col("name").alias("callee_owner"), F.col("fqn").alias("owner_fqn"), "short_id")
    named = owned.select("call_no", "file_id", "callee_owner", "callee_name").join(objects, ["file_id", "callee_owner"])
    first = named.join(by_owner, ["owner_fqn", "callee_name"]).groupBy("call_no").agg(F.min_by("method_id", "short_id").alias("p1"))
    return bare.unionByName(owned.join(first, "call_no", "left"))


def pass2(raw: RawTables, calls: DataFrame) -> DataFrame:
    """Adds p2: by the types of variables and by imports; the first candidate that has the method wins."""
    with_owner = var_lookup(raw, calls.where("callee_owner <> ''").select("call_no", "file_id", "caller_fqn", "callee_name", "callee_owner"))
    aliases = alias_map(raw)
    by = lambda col, to: aliases.select("file_id", F.col("alias").alias(col), F.col("target").alias(to))
    known = with_owner.join(by("var_type", "_tt"), ["file_id", "var_type"], "left").join(by("callee_owner", "_ot"), ["file_id", "callee_owner"], "left")
    dotted = lambda a, b: F.concat(F.col(a), F.lit("."), F.col(b))
    tries = F.array("var_type", "_tt", dotted("_tt", "var_type"), "_ot", dotted("_ot", "callee_owner"), "callee_owner")
    each = known.select("call_no", "callee_name", F.posexplode(tries).alias("pos", "owner_fqn")).where("owner_fqn is not null")
    by_owner = method_by_owner(raw).withColumnRenamed("name", "callee_name")
    found = each.join(by_owner, ["owner_fqn", "callee_name"]).groupBy("call_no").agg(F.min_by("method_id", "pos").alias("p2"))
    return calls.join(found, "call_no", "left")


def pass3(raw: RawTables, calls: DataFrame) -> DataFrame:
    """Adds p3: the only method of that name in the service."""
    names = unique_names(raw.methods, "p3").withColumnRenamed("name", "callee_name")
    return calls.join(names, "callee_name", "left")


def number_calls(raw: RawTables) -> DataFrame:
    return raw.calls.withColumn("call_no", F.struct("file_id", "ord"))


def resolve_calls(raw: RawTables, some: DataFrame | None = None, keyed: bool = False) -> DataFrame:
    """edges_calls: calls of unknown callers go; unresolved ones stay with confidence 0.

    A call that no method of the service has the name of can't be resolved by any pass and leaves before them; each pass gets
    only what the one before has left open, and what is decided is checkpointed, so no pass runs twice. `some`: only these
    calls (with call_no); `keyed` adds the place of the call.
    """
    callers = method_by_fqn(raw).withColumnsRenamed({"fqn": "caller_fqn", "method_id": "caller_id"})
    names = raw.methods.select(F.col("name").alias("callee_name")).distinct().withColumn("_known", F.lit(True))
    calls = cut((number_calls(raw) if some is None else some).join(callers, "caller_fqn").join(names, "callee_name", "left"))
    none = F.lit(None).cast("string")
    first = cut(pass1(raw, calls.where("_known")))
    open1 = first.where("p1 is null").drop("p1")
    second = cut(pass2(raw, open1.where(OWNED)))
    open2 = open1.where(f"not {OWNED}").unionByName(second.where("p2 is null").drop("p2"))
    third = pass3(raw, open2)
    key = ["file_id", "ord"] if keyed else []
    done = lambda rows, found, conf: rows.select("caller_id", found.alias("callee_id"), "callee_name", "callee_owner", "line", conf.alias("confidence"), *key)
    return (
        done(first.where("p1 is not null"), F.col("p1"), F.lit(100)).unionByName(done(second.where("p2 is not null"), F.col("p2"), F.lit(70)))
        .unionByName(done(third, F.col("p3"), F.when(F.col("p3").isNotNull(), 40).otherwise(0))).unionByName(done(calls.where("_known is null"), none, F.lit(0)))
    )


def resolve_inherits(raw: RawTables, some: DataFrame | None = None, keyed: bool = False) -> DataFrame:
    """edges_inherits: exact name, name under the module, import, unique simple name; unresolved bases stay. `some`: only
    these bases; `keyed` adds the place of the base."""
    bases = raw.bases if some is None else some
    fqns = object_by_fqn(raw)
    by = lambda col, to: fqns.select(F.col("fqn").alias(col), F.col("object_id").alias(to))
    aliases = alias_map(raw).select("file_id", F.col("alias").alias("hint"), F.col("target").alias("_t"))
    b = bases.join(by("hint", "_a"), "hint", "left").join(aliases, ["file_id", "hint"], "left")
    # bases without a prefix or without an alias have no key for these two, and would meet in one task under null
    bare, under = b.where("prefix = ''").withColumn("_b", F.lit(None).cast("string")), b.where("prefix <> ''").withColumn("_local", F.concat("prefix", F.lit("."), "hint"))
    b = under.join(by("_local", "_b"), "_local", "left").drop("_local").unionByName(bare)
    free, aliased = b.where("_t is null").withColumn("_c", F.lit(None).cast("string")), b.where("_t is not null")
    b = aliased.join(by("_t", "_c"), "_t", "left").unionByName(free).join(unique_names(raw.objects, "_d").withColumnRenamed("name", "hint"), "hint", "left")
    return b.select("child_id", F.coalesce("_a", "_b", "_c", "_d").alias("parent_id"), F.col("hint").alias("parent_hint"), "relation", *(["file_id", "ord"] if keyed else []))


def resolve_imports(raw: RawTables, some: DataFrame | None = None) -> DataFrame:
    """edges_imports: one for each file and raw name; null targets are external. `some`: only these imports."""
    targets = file_by_import(raw).withColumnRenamed("name", "raw")
    return (raw.imports if some is None else some).select("file_id", "raw").distinct().join(targets, "raw", "left").select("file_id", "target_file_id", "raw")


def nested_owners(raw: RawTables) -> DataFrame:
    """(node_id, owner_id): the object whose name is an object's name without its last segment."""
    owners = object_by_fqn(raw).withColumnsRenamed({"fqn": "_up", "object_id": "owner_id"})
    nested = raw.objects.select("node_id", ids.strip_last(F.col("fqn")).alias("_up"))
    return _owned(nested, owners, "_up")


def method_owners(raw: RawTables) -> DataFrame:
    owners = object_by_fqn(raw).withColumnsRenamed({"fqn": "owner_fqn", "object_id": "owner_id"})
    return _owned(raw.methods.select("node_id", "owner_fqn"), owners, "owner_fqn")


def _owned(nodes: DataFrame, owners: DataFrame, by: str) -> DataFrame:
    """(node_id, owner_id); the many nodes without an owner's name stay out of the join."""
    has = F.coalesce(by, F.lit("")) != ""
    free = nodes.where(~has).select("node_id", F.lit(None).cast("string").alias("owner_id"))
    return nodes.where(has).join(owners, by, "left").select("node_id", "owner_id").unionByName(free)


def search_docs(files: DataFrame, nodes: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    none = F.lit("")
    of_files = files.select(F.col("file_id").alias("doc_id"), F.lit("file").alias("doc_kind"), none.alias("name"), none.alias("fqn"), pre_tokenize(F.col("rel_path"), stop_words).alias("path"))
    of_nodes = nodes.join(files.select("file_id", "rel_path"), "file_id").select(
        F.col("node_id").alias("doc_id"), F.lit("node").alias("doc_kind"), pre_tokenize(F.col("name"), stop_words).alias("name"),
        pre_tokenize(F.col("fqn"), stop_words).alias("fqn"), pre_tokenize(F.col("rel_path"), stop_words).alias("path"),
    )
    return of_files.unionByName(of_nodes)


def files_table(raw: RawTables) -> DataFrame:
    return raw.files.select("file_id", F.col("file_no").cast("long").alias("short_id"), "key", "rel_path", "lang", F.coalesce("package", F.lit("")).alias("package"), F.lit("").alias("hash"))


def nodes_table(raw: RawTables) -> DataFrame:
    common = ["node_id", "short_id", "file_id"]
    objects = raw.objects.join(nested_owners(raw), "node_id").select(
        *common, F.lit("object").alias("kind"), "subkind", "name", "fqn", "owner_id", F.lit("global").alias("scope"), F.lit("").alias("signature"), "doc", "start_line", "end_line"
    )
    methods = raw.methods.join(method_owners(raw), "node_id").select(
        *common, F.lit("method").alias("kind"), "subkind", "name", "fqn", "owner_id", "scope", "signature", "doc", "start_line", "end_line"
    )
    return objects.unionByName(methods)


def index_tables(raw: RawTables, stop_words: list[str] | None = None, keyed: bool = False) -> IndexTables:
    """All six tables from the raw ones; `keyed` adds the places of calls and bases in their files."""
    files, nodes = files_table(raw), nodes_table(raw)
    return IndexTables(
        files=files, nodes=nodes, edges_calls=resolve_calls(raw, keyed=keyed), edges_inherits=resolve_inherits(raw, keyed=keyed),
        edges_imports=resolve_imports(raw), search_docs=search_docs(files, nodes, stop_words),
    )
