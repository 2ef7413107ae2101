"""Services: a versioned registry, configuration files, and index snapshots that are committed whole and kept for a time."""

from __future__ import annotations

import json
import os
import random
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .checkpoints import cut, tidy
from .functions import ids
from .functions.analyzer import STOP_WORDS
from .operators import search
from .plans import delta, resolve, stored
from .plans.raw import raw_tables
from .schemas import KEYED, PARSED_FILES, TABLES, IndexTables
from .sources.ignore import load_patterns
from .sources.parse import PARSERS, parse_files, parsed_only
from .sources.scan import listing, read_contents
from .versions import Conflict, VersionLog

DEFAULT_CONFIG = {"pathPrefix": "", "includeExt": [".py", ".java"], "ignoreFile": "service.ignore", "search": {"stopWords": STOP_WORDS}, "keepSeconds": 86_400}
#: Folders of writers that never committed go after this time at the earliest.
ORPHAN_SECONDS = 7 * 86_400


def home() -> str:
    """Path or URI of the registry and the snapshots; on a cluster a place that all executors see."""
    return files.full(os.environ.get("GRAPHLOOM_HOME") or os.path.expanduser("~/.graphloom"))


def sanitize(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_-]", "_", name)


def check_config(config: dict) -> dict:
    prefix = config.get("pathPrefix", "")
    if not config.get("includeExt"):
        raise ValueError("includeExt is empty")
    if prefix and not prefix.endswith(":"):
        raise ValueError("pathPrefix must end with ':'")
    return config


class Registry:
    """The services by name. Each change makes a new version of the whole; one that was made from an older version is refused."""

    #: Versions of the registry that are kept, for a look back.
    KEPT = 20

    def __init__(self, root: str | None = None):
        self.root = files.full(root) if root else home()
        self.log = VersionLog(f"{self.root}/registry")
        self.reload()

    def reload(self) -> None:
        self.version, found = self.log.latest()
        self.services: dict = found if found is not None else {}

    def save(self) -> None:
        """Commits the services as the next version; raises Conflict if another writer has changed them since they were read."""
        self.log.commit(self.version + 1, self.services)
        self.version += 1
        for version in self.log.versions()[: -self.KEPT]:
            self.log.forget(version)

    def _change(self, change) -> None:
        """Makes the change on what is there now, again if another writer is faster, so neither's is lost."""
        for attempt in range(10):
            self.reload()
            change(self.services)
            try:
                return self.save()
            except Conflict:
                if attempt == 9:
                    raise
                time.sleep(0.05 * random.random())

    def add(self, service: str, root: str, description: str = "", main_entities: list[str] | None = None) -> None:
        def change(all_of_them: dict) -> None:
            if service in all_of_them:
                raise ValueError(f"service {service!r} exists")
            all_of_them[service] = {"rootAbs": files.full(root), "description": description, "mainEntities": main_entities or []}

        self._change(change)

    def remove(self, service: str) -> None:
        def change(_: dict) -> None:
            self.get(service)
            del self.services[service]

        self._change(change)

    def update(self, service: str, description: str = "", main_entities: list[str] | None = None) -> None:
        """Empty values keep what is there."""

        def change(_: dict) -> None:
            entry = self.get(service)
            if description:
                entry["description"] = description
            if main_entities:
                entry["mainEntities"] = main_entities

        self._change(change)

    def get(self, service: str) -> dict:
        if service not in self.services:
            raise KeyError(f"unknown service {service!r}")
        return self.services[service]

    def names(self) -> list[str]:
        return sorted(self.services)

    def dir(self, service: str) -> str:
        return f"{self.root}/services/{service}"

    def config(self, service: str) -> dict:
        path = f"{self.dir(service)}/config.json"
        if not files.exists(path):
            files.write_json(path, DEFAULT_CONFIG)
        return check_config(json.loads(files.read_bytes(path)))

    def patterns(self, service: str) -> list[str]:
        path = f"{self.dir(service)}/service.ignore"
        return load_patterns(files.read_bytes(path).decode("utf-8")) if files.exists(path) else []


def parsed_rows(spark: SparkSession, listed: DataFrame, root: str) -> DataFrame:
    """Rows of schemas.PARSED_FILES of listed files, which are read here."""
    contents = read_contents(listed, root).withColumn("hash", F.sha2("content", 256))
    return parse_files(contents, ("size", "modified", "hash"))


def write_search(spark: SparkSession, path: str, posts: DataFrame | None = None, sizes: DataFrame | None = None) -> None:
    """What the search reads, from the documents under path, or from their postings and sizes where these are known."""
    index = IndexTables.read(spark, path, ())
    docs = index.search_docs
    stored.write_sorted(search.blocked_stats(search.doc_stats(docs) if sizes is None else sizes, stored.ids(index)), path, "doc_stats")
    stats = spark.read.parquet(f"{path}/doc_stats")
    stored.write_sorted(search.search_stats(stats), path, "search_stats")
    if posts is None:
        terms = spark.read.parquet(f"{path}/search_stats").first()["total_len"]
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), terms // stored.TASK_TERMS)
        # documents are dealt by their ids, so their postings, many times as many, are counted and meet the sizes where they are made
        posts = search.postings(docs.repartition(tasks, "doc_id"))
    stored.write_sorted(search.blocked_postings(posts, stats), path, "postings")
    tidy(spark)
    stored.write_sorted(search.posting_blocks(spark.read.parquet(f"{path}/postings")), path, "posting_blocks")


def write_index(index: IndexTables, path: str, also: tuple[str, ...] = ("search", "lookups"), posts: DataFrame | None = None, sizes: DataFrame | None = None) -> None:
    """The tables under path, with what search and lookups read beside them; duplicate ids are refused."""
    path = files.for_spark(path)
    spark = index.nodes.sparkSession
    stored.at_once(spark, [lambda name=name: stored.write_sorted(getattr(index, name), path, name) for name in TABLES])
    again = spark.read.parquet(f"{path}/nodes").groupBy("node_id").count().where("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"two symbols have the id {again[0]['node_id']}; the index is left as it was")
    also_written = {"search": lambda: write_search(spark, path, posts, sizes), "lookups": lambda: stored.write_derived(spark, path)}
    stored.at_once(spark, [also_written[name] for name in also])


def build(spark: SparkSession, root: str, config: dict, patterns: list[str], path: str) -> None:
    """Scan, parse, canonicalize, resolve: the whole tree into the tables under path."""
    listed = listing(spark, root, config["pathPrefix"], config["includeExt"], patterns)
    parsed_rows(spark, listed, root).write.parquet(f"{files.for_spark(path)}/parsed")
    parsed = spark.read.schema(PARSED_FILES).parquet(f"{files.for_spark(path)}/parsed")
    write_index(resolve.index_tables(raw_tables(parsed_only(parsed)), config["search"]["stopWords"] or None, keyed=True), path)


def rebuild(spark: SparkSession, root: str, config: dict, patterns: list[str], old_path: str, path: str) -> bool:
    """The tables under path from those under old_path and the files that have changed since; false, and nothing, if none has.

    Files whose size and time are the same aren't read. What they gave when they were parsed is in the old snapshot.
    """
    old_path, new_path = files.for_spark(old_path), files.for_spark(path)
    parsed = spark.read.schema(PARSED_FILES).parquet(f"{old_path}/parsed")
    now = cut(listing(spark, root, config["pathPrefix"], config["includeExt"], patterns).where(F.col("lang").isin(list(PARSERS))))
    known = parsed.select("key", "size", "modified")
    touched = cut(now.join(known, ["key", "size", "modified"], "left_anti"))
    removed = cut(parsed.select("key").join(now, "key", "left_anti"))
    if touched.isEmpty() and removed.isEmpty():
        return False
    fresh = cut(parsed_rows(spark, touched, root))
    moved = delta.few(touched.select("key").unionByName(removed))
    parsed.join(moved, "key", "left_anti").select(*parsed.columns).unionByName(fresh.select(*parsed.columns)).write.parquet(f"{new_path}/parsed")
    after = spark.read.schema(PARSED_FILES).parquet(f"{new_path}/parsed")
    # a file that was only touched gives what it gave before
    same = fresh.select("key", "hash").join(parsed.select("key", "hash"), ["key", "hash"], "left_semi").select("key")
    changed_keys = delta.few(moved.join(same, "key", "left_anti"))
    raw = raw_tables(parsed_only(after))
    before = raw_tables(parsed_only(parsed.join(changed_keys, "key", "left_semi").select(*parsed.columns)))
    own = delta.few(changed_keys.select(ids.file_id(F.col("key")).alias("file_id")))
    changed = delta.Changed(before, delta.of_files(raw, own))
    keyed = {name: spark.read.schema(schema).parquet(f"{old_path}/{name}") for name, schema in KEYED.items()}
    index, posts, sizes = delta.index_tables(IndexTables.read(spark, old_path), keyed, raw, changed, config["search"]["stopWords"] or None)
    write_index(index, path, posts=posts, sizes=sizes)
    return True


def snapshots(registry: Registry, service: str) -> VersionLog:
    """The log of the service's snapshots: {"index": folder, "made": seconds}."""
    return VersionLog(f"{registry.dir(service)}/snapshots")


def commit(registry: Registry, service: str, write, base: int, **about) -> int:
    """Lets `write(path)` make the tables of a snapshot and commits it as the version behind `base`; if it returns False there
    is nothing new, and the version stays.

    The tables go to a folder of their own, so nobody sees a snapshot before it is whole; if writing fails or another writer
    has committed meanwhile, the folder goes and the current snapshot stays.
    """
    folder, name = registry.dir(service), f"index-{int(time.time())}-{uuid.uuid4().hex}"
    try:
        if write(f"{folder}/{name}") is False:
            return base
        snapshots(registry, service).commit(base + 1, {"index": name, "made": time.time(), **about})
    except Exception:
        files.delete(f"{folder}/{name}")
        raise
    vacuum(registry, service)
    return base + 1


def sync(spark: SparkSession, registry: Registry, service: str, full: bool = False) -> IndexTables:
    """A new snapshot: of what has changed since the current one, or with `full`, without one, and under another configuration
    of the whole tree. Readers of older ones go on reading them until their keep time is over."""
    entry, folder = registry.get(service), registry.dir(service)
    if not files.is_uri(folder) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("executors of a cluster can't see a local home; set GRAPHLOOM_HOME to a shared URI")
    base, current = snapshots(registry, service).latest()
    config, patterns = registry.config(service), registry.patterns(service)
    made_by = {"root": entry["rootAbs"], "config": {k: config[k] for k in ("pathPrefix", "includeExt", "search")}, "patterns": patterns}
    how = (spark, entry["rootAbs"], config, patterns)
    if current and not full and current.get("made_by") == made_by:
        write = lambda path: rebuild(*how, f"{folder}/{current['index']}", path)
    else:
        write = lambda path: build(*how, path)
    version = commit(registry, service, write, base, made_by=made_by)
    return open_index(spark, registry, service, version)


def wipe(spark: SparkSession, registry: Registry, service: str) -> IndexTables:
    """An empty snapshot; what was there stays readable by its version for its keep time."""
    registry.get(service)
    empty = IndexTables(**{name: spark.createDataFrame([], schema) for name, schema in TABLES.items()})
    version = commit(registry, service, lambda path: write_index(empty, path), snapshots(registry, service).latest()[0])
    return open_index(spark, registry, service, version)


def vacuum(registry: Registry, service: str, keep_seconds: float | None = None) -> list[str]:
    """Deletes the folders of snapshots that were replaced longer ago than the keep time, and those that failed writers have
    left behind; returns their names. The current snapshot always stays."""
    keep = registry.config(service).get("keepSeconds", DEFAULT_CONFIG["keepSeconds"]) if keep_seconds is None else keep_seconds
    log, folder, now, gone = snapshots(registry, service), registry.dir(service), time.time(), []
    every = [(v, log.read(v)) for v in log.versions()]
    for (version, own), (_, later) in zip(every, every[1:]):
        if now - later["made"] >= keep:
            log.forget(version)
            files.delete(f"{folder}/{own['index']}")
            gone.append(own["index"])
    known = {own["index"] for _, own in every}
    for name in files.names(folder):
        made = re.fullmatch(r"index-(\d+)-[0-9a-f]+", name)
        if made and name not in known and now - int(made[1]) > max(keep, ORPHAN_SECONDS):
            files.delete(f"{folder}/{name}")
            gone.append(name)
    return gone


def history(registry: Registry, service: str) -> list[dict]:
    """The snapshots that can be opened, oldest first: version and the second it was made."""
    log = snapshots(registry, service)
    return [{"version": v, "made": log.read(v)["made"]} for v in log.versions()]


def open_index(spark: SparkSession, registry: Registry, service: str, version: int | None = None) -> IndexTables:
    """The current snapshot, or that of a version which is still kept."""
    registry.get(service)
    log = snapshots(registry, service)
    if version is not None and version not in log.versions():
        raise KeyError(f"service {service!r} has no snapshot {version}; it was never made, or its keep time is over")
    _, found = log.latest() if version is None else (version, log.read(version))
    if not found:
        raise ValueError(f"service {service!r} has no index; run sync")
    return IndexTables.read(spark, files.for_spark(f"{registry.dir(service)}/{found['index']}"))
