"""The operations of the API, with results shaped as JSON values."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from . import service as services
from .functions import ids
from .operators import lookups, search, walks, whole
from .sources.scan import read_file


def _rows(df: DataFrame, limit: int | None = None) -> list[dict]:
    return [r.asDict() for r in (df.limit(limit) if limit else df).collect()]


def _slim(row: dict, always: tuple[str, ...] = ()) -> dict:
    """Without empty values, as optional fields are left out of the answers."""
    return {k: v for k, v in row.items() if k in always or v not in (None, "", 0, [])}


class App:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.registry = spark, services.Registry(root)

    def _index(self, service: str):
        return services.open_index(self.spark, self.registry, service)

    # -- services

    def services(self) -> list[dict]:
        return [self.info(s) for s in self.registry.names()]

    def info(self, service: str) -> dict:
        e = self.registry.get(service)
        return _slim({"id": service, "root": e["rootAbs"], "description": e["description"], "mainEntities": e["mainEntities"]}, ("id", "root"))

    def add_service(self, root: str, service: str = "", description: str = "", main_entities: list[str] | None = None) -> dict:
        name = services.sanitize(service or os.path.basename(files.full(root).rstrip("/")))
        self.registry.add(name, root, description, main_entities)
        self.sync(name)
        return self.info(name)

    def update_service_meta(self, service: str, description: str = "", main_entities: list[str] | None = None) -> dict:
        self.registry.update(service, description, main_entities)
        return self.info(service)

    def sync(self, service: str, full: bool = False) -> dict:
        services.sync(self.spark, self.registry, service, full)
        return self.stats(service)

    def history(self, service: str) -> list[dict]:
        """The snapshots that are kept, oldest first."""
        self.registry.get(service)
        return services.history(self.registry, service)

    def stats(self, service: str) -> dict:
        return _rows(lookups.stats(self._index(service)))[0]

    # -- queries

    def search(self, service: str, query: str, kind: str | None = None, limit: int = 10) -> dict:
        stops = self.registry.config(service)["search"]["stopWords"]
        hits = search.search(self._index(service), query, kind, limit, stops)
        out = [_slim({k: h[k] for k in ("id", "k", "name", "fqn", "file", "l")}, ("id", "k")) for h in _rows(hits)]
        return {"hits": out or None}

    def _resolve(self, index, node: str) -> str:
        if node.startswith(("n:", "f:")):
            return node
        if not ids.parse_short(node):
            raise ValueError(f"bad id {node!r}")
        found = lookups.find_id(index, node).first()
        if not found:
            raise KeyError(f"unknown id {node!r}")
        return found["canonical_id"]

    def _node(self, index, node: str) -> dict:
        """The node with its file and its owner: three filters on sorted tables, no join."""
        rows = _rows(index.nodes.where(F.col("node_id") == node), 1)
        if not rows:
            raise KeyError(f"unknown id {node!r}")
        file = _rows(index.files.where(F.col("file_id") == rows[0]["file_id"]).select(F.col("short_id").alias("file_no"), "key", "rel_path", "lang"), 1)
        owner = _rows(index.nodes.where(F.col("node_id") == rows[0]["owner_id"]).select(F.col("short_id").alias("owner_no")), 1) if rows[0]["owner_id"] else []
        return rows[0] | (file[0] if file else {}) | (owner[0] if owner else {"owner_no": None})

    def peek(self, service: str, node: str) -> dict:
        index = self._index(service)
        node = self._resolve(index, node)
        if node.startswith("f:"):
            f = self._file_row(index, node)
            t = _rows(index.file_counts.where(F.col("file_id") == f["file_id"]))[0]
            head = {"id": f"f{f['short_id']}", "k": "file", "path": f["rel_path"], "lang": f["lang"], "pkg": f["package"]}
            counts = {"objects": t["objects"], "methods": t["methods"], "imports": t["imports"]}
            return _slim(head | counts, ("id", "k", "path", "objects", "methods", "imports"))
        n = self._node(index, node)
        mark = "o" if n["kind"] == "object" else "m"
        head = {
            "id": f"{mark}{n['short_id']}", "k": n["kind"], "subk": n["subkind"], "name": n["name"], "fqn": n["fqn"], "file": n["rel_path"],
            "l": n["start_line"], "end": n["end_line"], "doc": n["doc"], "owner": f"o{n['owner_no']}" if n["owner_no"] is not None else "",
        }
        always = ("id", "k", "subk", "name", "file", "l", "end")
        if n["kind"] == "method":
            c = _rows(index.node_counts.where(F.col("node_id") == node))[0]
            more = {"sig": n["signature"], "calls": c["calls"], "called_by": c["called_by"], "unresolved_calls": c["unresolved"]}
            return _slim(head | more, always)
        c = _rows(index.node_counts.where(F.col("node_id") == node))[0]
        children = [r["peer"] for r in _rows(walks.walk(index, node, "defines", "out", 200)[0])]
        parents = [r for r in _rows(walks.walk(index, node, "inherits", "out", 50)[0]) if r["peer"]]
        by = lambda rel: [r["peer"] for r in parents if r["rel"] == rel]
        return _slim(head | {"methods": children, "extends": by("extends"), "implements": by("implements"), "extended_by": c["extended_by"]}, always)

    def walk(self, service: str, node: str, edge: str, direction: str = "both", limit: int = 20, offset: int = 0) -> dict:
        index = self._index(service)
        rows, total = walks.walk(index, self._resolve(index, node), edge, direction, limit, offset)
        items = []
        for r in _rows(rows):
            side = "from" if r["dir"] == "in" else "to"
            items.append(_slim({side: r["peer"]} | {k: r[k] for k in ("name", "fqn", "file", "l", "hint", "line", "conf", "rel")}))
        return {"items": items or None, "total": total}

    def code(self, service: str, node: str, context: int = 0) -> dict:
        index = self._index(service)
        node = self._resolve(index, node)
        if node.startswith("f:"):
            raise ValueError("code takes the id of an object or a method")
        r = self._node(index, node)
        start, end = max(r["start_line"] - context, 1), r["end_line"] + context
        content = read_file(self.registry.get(service)["rootAbs"], r["rel_path"])
        row = self.spark.createDataFrame([(content.decode("utf-8", "replace"),)], "value string")
        lines = whole.code_lines(F.col("value"), F.lit(start), F.lit(end))
        mark = "o" if r["kind"] == "object" else "m"
        return {"id": f"{mark}{r['short_id']}", "file": r["rel_path"], "start": start, "end": end, "src": row.select(lines.alias("src")).first()["src"]}

    def _file_row(self, index, path_or_id: str) -> dict:
        rows = _rows(lookups.get_file(index, path_or_id), 1)
        if not rows:
            raise KeyError(f"unknown file {path_or_id!r}")
        return rows[0]

    def file(self, service: str, path_or_id: str) -> dict:
        index = self._index(service)
        wanted = self._resolve(index, path_or_id) if ids.parse_short(path_or_id) else path_or_id
        f = self._file_row(index, wanted)
        own = F.col("file_id") == f["file_id"]
        imports = _rows(walks.walk_rows(index, "imports", "out").where(F.col("node") == f["file_id"]).orderBy("hint").select(F.col("hint").alias("raw"), "peer"))
        objects = _rows(lookups.file_objects(index).where(own).orderBy("start_line", "short_id"))
        methods = _rows(lookups.file_top_methods(index).where(own).orderBy("start_line", "short_id"))
        brief = lambda r, mark: _slim({"id": f"{mark}{r['short_id']}", "subk": r["subkind"], "name": r["name"], "l": r["start_line"], "end": r["end_line"], "methods": r.get("methods", 0)}, ("id", "name", "l"))
        return _slim({
            "id": f"f{f['short_id']}", "path": f["rel_path"], "lang": f["lang"], "pkg": f["package"],
            "imports": [_slim({"raw": r["raw"], "tgt": r["peer"] or ""}, ("raw",)) for r in imports],
            "objects": [brief(r, "o") for r in objects], "methods": [brief(r, "m") for r in methods],
        }, ("id", "path"))

    def tree(self, service: str, limit: int = 0, offset: int = 0) -> dict:
        """All files, or a page of them."""
        rows = whole.tree(self._index(service)).orderBy("path")
        rows = _rows(rows.offset(offset).limit(limit) if limit > 0 else rows)
        return {"files": [_slim(r, ("id", "path")) for r in rows]}

    def graph(self, service: str) -> dict:
        nodes, edges = whole.graph(self._index(service))
        return {"nodes": [_slim(r, ("id", "k", "name")) for r in _rows(nodes)], "edges": [_slim(r, ("from", "to", "t")) for r in _rows(edges)]}

    def export_graph(self, service: str, path: str) -> dict:
        """The graph as Parquet under path, for indexes that no single answer can hold."""
        path = files.for_spark(path).rstrip("/")
        for name, rows in zip(("nodes", "edges"), whole.graph(self._index(service))):
            rows.write.mode("overwrite").parquet(f"{path}/{name}")
        return {"nodes": f"{path}/nodes", "edges": f"{path}/edges"}
