"""A source tree as a Spark data source, for batches and streams: spark.read.format("tree"), spark.readStream.format("tree").

Spark's own file sources leave out names that begin with an underscore or a dot, `__init__.py` among them; this one takes all
that the ignore patterns leave. Options: path (of any store that Arrow opens), extensions (with commas between), prefix (of
keys), ignore (a pattern a line).

A partition is a directory two levels down with all below it, or the files of one above; tasks list what they read, and look
into no ignored directory. The offset of a stream is the latest time of change that a listing has shown: a batch holds the
files that changed behind the last offset, up to its own, so a restart goes on where the last batch ended. Files younger than
`settle` seconds wait, as others of the same time may follow. What is moved into the tree with an older time is seen by
batches and syncs alone, and what is deleted by syncs.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .. import files
from .ignore import is_ignored
from .scan import BATCH_BYTES, BATCH_FILES

SCHEMA = "key string, rel_path string, size long, modified long, content binary"
_FIELDS = [("key", pa.string()), ("rel_path", pa.string()), ("size", pa.int64()), ("modified", pa.int64()), ("content", pa.binary())]


@dataclass
class Part(InputPartition):
    """A directory, with what is below it or without, and the times of change that are wanted."""

    folder: str
    deep: bool
    after: int = -1
    upto: int = 2**63 - 1


class Tree:
    """The tree of the options: listing and reading."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.prefix = options.get("prefix", "")
        self.extensions = {e.strip().lower() for e in options.get("extensions", "").split(",") if e.strip()}
        self.patterns = [p for p in options.get("ignore", "").split("\n") if p]
        self.settle = float(options.get("settle", "1"))

    def entries(self, folder: str) -> list:
        """(relative path, Arrow's file info) of what lies in a folder and isn't ignored."""
        from pyarrow.fs import FileSelector

        fs, base = files.opened(self.root)
        found = fs.get_file_info(FileSelector(f"{base}/{folder}" if folder else base))
        named = [(i.path[len(base) + 1 :], i) for i in found]
        return sorted((p, i) for p, i in named if not is_ignored(p, self.patterns))

    def files(self, folder: str, deep: bool) -> Iterator[tuple]:
        todo = [folder]
        while todo:
            for path, info in self.entries(todo.pop()):
                if not info.is_file:
                    todo += [path] if deep else []
                elif not self.extensions or os.path.splitext(path)[1].lower() in self.extensions:
                    yield path, info

    def parts(self, after: int = -1, upto: int = 2**63 - 1) -> list[Part]:
        out, top = [Part("", False, after, upto)], [p for p, i in self.entries("") if not i.is_file]
        for folder in top:
            out.append(Part(folder, False, after, upto))
            out += [Part(p, True, after, upto) for p, i in self.entries(folder) if not i.is_file]
        return out

    def latest(self, settled_before: int) -> int:
        """The latest time of change of any file that has settled; -1 where there is none."""
        times = (info.mtime_ns or 0 for _, info in self.files("", True))
        return max((t for t in times if t <= settled_before), default=-1)

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        fs, base = files.opened(self.root)
        rows, size = [], 0
        for path, info in self.files(part.folder, part.deep):
            if part.after < (info.mtime_ns or 0) <= part.upto:
                with fs.open_input_stream(f"{base}/{path}") as f:
                    content = f.read()
                rows.append((self.prefix + path, path, info.size, info.mtime_ns or 0, content))
                size += len(content)
                if len(rows) >= BATCH_FILES or size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, (_, kind) in zip(zip(*rows), _FIELDS)], names=[name for name, _ in _FIELDS])


class TreeReader(DataSourceReader):
    def __init__(self, tree: Tree):
        self.tree = tree

    def partitions(self) -> list[Part]:
        return self.tree.parts()

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.tree.read(partition)


class TreeStream(DataSourceStreamReader):
    def __init__(self, tree: Tree):
        self.tree, self.last = tree, -1

    def initialOffset(self) -> dict:
        return {"modified": -1}

    def latestOffset(self) -> dict:
        self.last = max(self.last, self.tree.latest(time.time_ns() - int(self.tree.settle * 1e9)))
        return {"modified": self.last}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.tree.parts(start["modified"], end["modified"])

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return self.tree.read(partition)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(Tree(self.options))

    def streamReader(self, schema) -> TreeStream:
        return TreeStream(Tree(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)


def options(root: str, extensions: list[str] | None = None, prefix: str = "", patterns: list[str] | None = None) -> dict[str, str]:
    return {"path": root, "extensions": ",".join(extensions or []), "prefix": prefix, "ignore": "\n".join(patterns or [])}
