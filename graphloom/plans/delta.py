"""The tables of a snapshot from those of the one before and from the files that have changed.

What a reference resolves to follows from names alone: those of methods and objects, of variables with a type, of modules and
imported names. So a reference in a file that hasn't changed can only resolve to something else if a name that it goes by is
declared in a changed file, before or after the change. Those references are found by semi-joins with the changed names (a
few, so they are broadcast behind a count), resolved anew together with those of the changed files, and put in the place of
the old ones. All others keep their rows. Numbers, owners and counts follow from the merged tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions import ids
from ..operators import search
from ..schemas import IndexTables
from . import resolve
from .raw import RawTables

#: Rows of a set of names or keys that is broadcast; larger ones are joined.
FEW = 200_000


def few(rows: DataFrame) -> DataFrame:
    rows = cut(rows.distinct())
    return F.broadcast(rows) if rows.count() <= FEW else rows


@dataclass
class Changed:
    """What the changed files declare, before and after: `before` and `after` are their raw tables."""

    before: RawTables
    after: RawTables

    def _both(self, of) -> DataFrame:
        return of(self.before).unionByName(of(self.after))

    def method_names(self) -> DataFrame:
        return few(self._both(lambda r: r.methods.select("name")))

    def method_fqns(self) -> DataFrame:
        return few(self._both(lambda r: r.methods.select("fqn")))

    def object_names(self) -> DataFrame:
        return few(self._both(lambda r: r.objects.select("name")))

    def variables(self) -> DataFrame:
        return few(self._both(lambda r: r.var_types.select("var_name")))

    def imported(self) -> DataFrame:
        """The names that an import can lead to one of the files by."""
        of = lambda r: r.files.select(F.col("module").alias("raw")).unionByName(r.objects.select(F.col("fqn").alias("raw"))).unionByName(r.objects.select(F.col("name").alias("raw")))
        return few(self._both(of))

    def file_ids(self) -> DataFrame:
        return few(self._both(lambda r: r.files.select("file_id")))

    def documents(self) -> DataFrame:
        """Ids of the files' own documents and of their nodes', as they were and as they are."""
        of = lambda r: r.files.select(F.col("file_id").alias("doc_id")).unionByName(r.objects.select(F.col("node_id").alias("doc_id"))).unionByName(r.methods.select(F.col("node_id").alias("doc_id")))
        return few(self._both(of))


def of_files(raw: RawTables, files: DataFrame) -> RawTables:
    """The raw tables of some files alone (column file_id)."""
    own = {name: getattr(raw, name).join(files, "file_id", "left_semi") for name in ("files", "objects", "methods", "bases", "calls", "imports")}
    numbers = few(own["files"].select("file_no"))
    return RawTables(**own, var_types=raw.var_types.join(numbers, "file_no", "left_semi"))


def _hit(rows: DataFrame, by, names: DataFrame, mark: str) -> DataFrame:
    """rows with a flag: whether `by` is one of the names."""
    (own,) = names.columns
    flagged = names.select(F.col(own).alias(f"_{mark}_name"), F.lit(True).alias(mark))
    return rows.join(flagged, by == F.col(f"_{mark}_name"), "left").drop(f"_{mark}_name")


def affected_calls(raw: RawTables, changed: Changed, files: DataFrame) -> DataFrame:
    """The calls to resolve anew: of the changed files, of callers and methods of changed names, and by variables of such."""
    calls = resolve.number_calls(raw)
    calls = _hit(calls, F.col("file_id"), files, "_f")
    calls = _hit(calls, F.col("callee_name"), changed.method_names(), "_m")
    calls = _hit(calls, F.col("caller_fqn"), changed.method_fqns(), "_c")
    calls = _hit(calls, F.col("callee_owner"), changed.variables(), "_v")
    return cut(calls.where("_f or _m or _c or _v").select(*resolve.number_calls(raw).columns))


def affected_bases(raw: RawTables, changed: Changed, files: DataFrame) -> DataFrame:
    """The bases to resolve anew: every way to a parent ends in its simple name, by the hint or by what is imported under it."""
    names = changed.object_names()
    aliases = resolve.alias_map(raw).select("file_id", F.col("alias").alias("hint"), F.col("target").alias("_t"))
    bases = raw.bases.join(aliases, ["file_id", "hint"], "left")
    bases = _hit(bases, F.col("file_id"), files, "_f")
    bases = _hit(bases, ids.last_segment(F.col("hint")), names, "_h")
    bases = _hit(bases, ids.last_segment(F.col("_t")), names, "_a")
    return cut(bases.where("_f or _h or _a").select(*raw.bases.columns))


def affected_imports(raw: RawTables, changed: Changed, files: DataFrame) -> DataFrame:
    imports = _hit(raw.imports, F.col("file_id"), files, "_f")
    return cut(_hit(imports, F.col("raw"), changed.imported(), "_r").where("_f or _r").select("file_id", "raw").distinct())


def merged(old: DataFrame, new: DataFrame, files: DataFrame, affected: DataFrame, key: list[str]) -> DataFrame:
    """The old rows but those of the changed files and of what was resolved anew, and the new ones."""
    stay = old.join(files, "file_id", "left_anti").join(few(affected.select(*key)), key, "left_anti")
    return stay.select(*old.columns).unionByName(new.select(*old.columns))


def index_tables(old: IndexTables, keyed: dict[str, DataFrame], raw: RawTables, changed: Changed, stop_words: list[str] | None) -> tuple[IndexTables, DataFrame, DataFrame]:
    """The tables after the change; the postings and the sizes of their documents, without blocks. `keyed`: the old edges with
    the places of their calls and bases; raw: the raw tables after the change."""
    gone = changed.file_ids()
    calls, bases, imports = affected_calls(raw, changed, gone), affected_bases(raw, changed, gone), affected_imports(raw, changed, gone)
    files, nodes = resolve.files_table(raw), cut(resolve.nodes_table(raw))
    own = files.join(gone, "file_id", "left_semi")
    docs = cut(resolve.search_docs(own, nodes.join(gone, "file_id", "left_semi"), stop_words))
    rewritten = changed.documents()
    rest = lambda df: df.join(rewritten, "doc_id", "left_anti").select(*df.columns)
    index = IndexTables(
        files=files, nodes=nodes,
        edges_calls=merged(keyed["edges_calls"], resolve.resolve_calls(raw, calls, keyed=True), gone, calls, ["file_id", "ord"]),
        edges_inherits=merged(keyed["edges_inherits"], resolve.resolve_inherits(raw, bases, keyed=True), gone, bases, ["child_id", "ord"]),
        edges_imports=merged(old.edges_imports, resolve.resolve_imports(raw, imports), gone, imports, ["file_id", "raw"]),
        search_docs=rest(old.search_docs).unionByName(docs),
    )
    posts = rest(old.postings.select("term", "doc_id", "tf_name", "tf_fqn", "tf_path")).unionByName(search.postings(docs))
    sizes = rest(old.doc_stats.select("doc_id", "doc_kind", "len")).unionByName(search.doc_stats(docs))
    return index, posts, sizes
