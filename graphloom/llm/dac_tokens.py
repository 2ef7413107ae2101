"""Token ids of a corpus in files of directly addressable codes.

An id is split into chunks of bits, lowest first. Level 0 holds the first chunk of every id of the file; a bitmap tells
which ids go on, and the next level holds the next chunk of those alone. The place of an id in the next level is the
number of set bits before it (its rank), which a directory of counts, one for each 512 bits, makes one look-up and one
count in 64 bytes. So any token is read with a few bytes of each level and no block is decoded. The widths of a file's levels are
those of least size for the ids it holds.

A file, little-endian:

    8 bytes "DACTOK01"; u32 length of the header; header (JSON: tokens, docs, end_id, sections {name: [first byte, bytes]},
    levels [{width, count}]); then the sections, each at a multiple of 8 bytes behind the header:
    doc_ids i64, doc_null one byte each, doc_first u64 (docs + 1 of them), and for level k: chunks.k (packed bits, 8 spare
    bytes), bits.k (bitmap), ranks.k (u32). The last level has no bitmap.

Documents are range-partitioned by id, a task writes the files of its range, and `manifest` (Parquet, beside the folder
`data`) has one row a file with the number of its first token in the whole output. Files are written under a name of the
attempt and moved, so a repeated task leaves the same files.

Defined results: a null text is empty and an empty text is the end id alone; texts of any length are encoded whole (they
are cut at ASCII white space, at which this kind of vocabulary cuts as well, `white_space_is_dropped` checks that); ids
ascend, null ids are last; rows of one id follow a hash of their text, equal rows are written one by one and may lie in several tasks; extra columns
are ignored; an empty table gives an empty manifest and no files.
"""

from __future__ import annotations

import functools
import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..files import opened
from .shared import arrow_slices, byte_words, fresh, map_arrow

MAGIC, BLOCK = b"DACTOK01", 512


# Codes


def level_widths(ids: np.ndarray) -> list[int]:
    """The chunk widths, lowest first, that take the fewest bits for these ids."""
    lengths = np.bincount(np.frexp(ids.astype(np.float64))[1], minlength=2)
    most = max(1, int(np.flatnonzero(lengths)[-1])) if len(ids) else 1
    left = [len(ids)] + [int(lengths[b + 1 :].sum()) for b in range(1, most + 1)]  # ids that reach beyond bit b
    best: dict[int, tuple[float, list[int]]] = {most: (0.0, [])}
    for b in range(most - 1, -1, -1):
        ways = []
        for w in range(1, min(24, most - b) + 1):
            mark = 0 if b + w == most else 1 + 32 / BLOCK
            ways.append((left[b] * (w + mark) + best[b + w][0], [w, *best[b + w][1]]))
        best[b] = min(ways)
    return best[0][1]


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Values of `width` bits one after the other, lowest bit first, and 8 spare bytes."""
    n = -(-len(values) // 8)
    eight = np.zeros((n, 8), np.uint64)
    eight.reshape(-1)[: len(values)] = values
    out = np.zeros((n, width), np.uint8)  # 8 values fill `width` bytes
    for k in range(8):
        first = k * width
        shifted = eight[:, k] << np.uint64(first % 8)
        for j in range(first // 8, (first + width - 1) // 8 + 1):
            out[:, j] |= ((shifted >> np.uint64(8 * (j - first // 8))) & np.uint64(255)).astype(np.uint8)
    return out.tobytes() + bytes(8)


def unpack_bits(packed: np.ndarray, bit: np.ndarray, width: int) -> np.ndarray:
    """The values that begin at the given bits."""
    byte, out = bit >> 3, np.zeros(len(bit), np.uint32)  # widths reach 24 bits, so a value lies in 4 bytes
    for k in range((width + 14) // 8):
        out |= packed[byte + k].astype(np.uint32) << np.uint32(8 * k)
    return (out >> (bit & 7).astype(np.uint32)) & np.uint32((1 << width) - 1)


def encode_file(docs: list[tuple[int | None, np.ndarray]], end_id: int) -> bytes:
    """The bytes of a file with these documents' ids (the end id of each among them)."""
    ids = np.concatenate([x for _, x in docs]) if docs else np.zeros(0, np.uint32)
    first = np.zeros(len(docs) + 1, np.uint64)
    np.cumsum([len(x) for _, x in docs], out=first[1:])
    parts = {
        "doc_ids": np.array([d or 0 for d, _ in docs], np.int64).tobytes(),
        "doc_null": np.array([d is None for d, _ in docs], np.uint8).tobytes(),
        "doc_first": first.tobytes(),
    }
    levels, rest = [], ids
    widths = level_widths(ids)
    for k, width in enumerate(widths):
        levels.append({"width": width, "count": len(rest)})
        parts[f"chunks.{k}"] = pack_bits(rest & np.uint32((1 << width) - 1), width)
        if k + 1 < len(widths):
            rest = rest >> np.uint32(width)
            goes_on = rest > 0
            bits = np.packbits(goes_on, bitorder="little")
            bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
            counts = np.bitwise_count(bits.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.int64)
            parts[f"bits.{k}"] = bits.tobytes()
            parts[f"ranks.{k}"] = (np.cumsum(counts) - counts).astype(np.uint32).tobytes()
            rest = rest[goes_on]
    sections, size = {}, 0
    for name, data in parts.items():
        sections[name] = [size, len(data)]
        size += len(data) + -len(data) % 8
    header = json.dumps({"tokens": len(ids), "docs": len(docs), "end_id": end_id, "sections": sections, "levels": levels}).encode()
    header += b" " * (-(len(MAGIC) + 4 + len(header)) % 8)
    body = b"".join(data + bytes(-len(data) % 8) for data in parts.values())
    return MAGIC + len(header).to_bytes(4, "little") + header + body


class TokenFile:
    """A file of codes over anything with size and read_at: an Arrow file, or bytes."""

    def __init__(self, source):
        self.source = pa.BufferReader(source) if isinstance(source, bytes) else source
        head = self._bytes(0, 12)
        if head[:8] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        n = int.from_bytes(head[8:12], "little")
        self.header = json.loads(self._bytes(12, n))
        self.base = 12 + n
        self.n_tokens, self.n_docs = self.header["tokens"], self.header["docs"]
        self.levels = self.header["levels"]

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return bytes(self.source.read(n))

    def _part(self, name: str, at: int, n: int) -> np.ndarray:
        first, size = self.header["sections"][name]
        return np.frombuffer(self._bytes(self.base + first + at, min(n, size - at)), np.uint8)

    def docs(self) -> tuple[list[int | None], np.ndarray]:
        """Ids of the documents in their order, and the first token of each, with the number of tokens behind them."""
        whole = lambda name, kind: self._part(name, 0, self.header["sections"][name][1]).view(kind)
        ids = [None if gone else int(d) for d, gone in zip(whole("doc_ids", np.int64), whole("doc_null", np.uint8))]
        return ids, whole("doc_first", np.uint64).astype(np.int64)

    def _rank(self, k: int, i: int) -> tuple[int, bool]:
        """Set bits of level k before place i, and whether bit i is set."""
        block = i // BLOCK
        before = int(self._part(f"ranks.{k}", 4 * block, 4).view(np.uint32)[0])
        bits = np.unpackbits(self._part(f"bits.{k}", block * (BLOCK // 8), BLOCK // 8), bitorder="little")
        return before + int(bits[: i % BLOCK].sum()), bool(bits[i % BLOCK])

    def token(self, i: int) -> int:
        """The id at place i of the file; reads some 80 bytes of each level that it reaches."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        out, shift = 0, 0
        for k, level in enumerate(self.levels):
            width = level["width"]
            near = int.from_bytes(self._part(f"chunks.{k}", i * width // 8, 5).tobytes(), "little")
            out |= ((near >> (i * width % 8)) & ((1 << width) - 1)) << shift
            shift += width
            if k + 1 == len(self.levels):
                break
            i, goes_on = self._rank(k, i)
            if not goes_on:
                break
        return out

    def tokens(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """The ids at places a to b (not with b), level by level."""
        b = self.n_tokens if b is None else b
        out, shift, where = np.zeros(b - a, np.uint32), 0, np.arange(b - a)
        for k, level in enumerate(self.levels):
            if b <= a:
                break
            width = level["width"]
            first = a * width // 8
            near = self._part(f"chunks.{k}", first, b * width // 8 - first + 8)
            out[where] |= unpack_bits(near, np.arange(a, b) * width - 8 * first, width) << np.uint32(shift)
            shift += width
            if k + 1 == len(self.levels):
                break
            bits = np.unpackbits(self._part(f"bits.{k}", a // 8, (b + 7) // 8 - a // 8), bitorder="little")[a % 8 :][: b - a]
            where = where[bits.astype(bool)]
            a = self._rank(k, a)[0]
            b = a + len(where)
        return out


# Tokens


#: What a tokenizers file of this kind says of its steps, and its pattern in terms of Python's engine for
#: lowered texts of the characters of PLAIN, on whose classes engines agree.
KIND = {"normalizer": ["NFC", "Replace", "Lowercase"], "pattern": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "end": "</w>"}
_SPACE = " \t\n\x0b\x0c\r"
NOT_PLAIN = re.compile(f"[^{_SPACE}!-~\u00a1-\u017f\u2010-\u2027\u2030-\u205e]")
_L, _N = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
PIECES = re.compile(f"[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_N}]|[^{_L}{_N}{_SPACE}]+")


class _Cache(dict):
    """What `make` gives for a key, as bytes. A full table becomes the older one, of which what is asked for comes back; what
    is forgotten is made anew, so sizes change no result."""

    def __init__(self, make, limit: int, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            self[key] = value
        return value

    def join(self, keys: list) -> bytes:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, keys))


class RunTokenizer:
    """Ids of whole texts from a tokenizers file that drops white space, put together from the ids of parts that come again.

    Texts of plain characters are cut into the vocabulary's pieces here, and new pieces are merged by a second engine, to which
    a byte that no text has stands for the end of a word. It gives the same ids in a fraction of the time (the tests compare
    them). Other texts are cut at ASCII white space; runs that aren't plain, and all runs of files of another kind, go through
    the library.
    """

    def __init__(self, path: str, pieces: int = 250_000, runs: int = 50_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if not white_space_is_dropped(self.library):
            raise ValueError(f"{path} gives ids to white space, so its texts can't be encoded run by run")
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.special = [t["content"] for t in made["added_tokens"]]
        self.engine = _engine(made)
        self.pieces, self.runs = _Cache(self._piece, pieces), _Cache(self._run, runs)

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if text and self._plain(text):
            return self.pieces.join(PIECES.findall(text.lower()))
        return self.runs.join(byte_words(text))

    def _plain(self, text: str) -> bool:
        return self.engine is not None and not NOT_PLAIN.search(text) and not any(t in text for t in self.special)

    def _run(self, run: bytes) -> bytes:
        text = run.decode("utf-8", "surrogatepass")
        if self._plain(text):
            return self.pieces.join(PIECES.findall(text.lower()))
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        return array("I", self.engine.encode_single_piece(piece.encode() + b"\xff")).tobytes()


def _engine(made: dict):
    """The merges of the file for the second engine, or None where the file is of another kind."""
    import tiktoken

    model, steps = made["model"], made["normalizer"] or {}
    cut_by = [x.get("pattern", {}).get("Regex") for x in (made["pre_tokenizer"] or {}).get("pretokenizers", [])]
    kinds = [x["type"] for x in steps.get("normalizers", [])]
    if kinds != KIND["normalizer"] or KIND["pattern"] not in cut_by or model.get("end_of_word_suffix") != KIND["end"]:
        return None
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special, ranks = {t["id"] for t in made["added_tokens"]}, {}
    for t, i in model["vocab"].items():
        if i not in special:
            ends = t.endswith(KIND["end"]) and i >= 256
            ranks[bytes(byte_of[c] for c in (t.removesuffix(KIND["end"]) if ends else t)) + b"\xff" * ends] = i
    return tiktoken.Encoding("file", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> RunTokenizer:
    """One for each Python worker, which keeps its runs from task to task."""
    return RunTokenizer(path)


def white_space_is_dropped(library) -> bool:
    """Whether ASCII white space only separates: it has no ids, in whatever number and wherever it stands."""
    of = lambda text: library.encode(text, add_special_tokens=False).ids
    runs = ["a", "'s", "12", "\u0301b", "?!", "\u00e9"]
    apart = [i for run in runs for i in of(run)]
    return all(of(x) == [] and of(x + x.join(runs) + x) == apart for x in " \t\n\x0b\x0c\r") and of(" \n \t".join(runs)) == apart


# Spark


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2, file_tokens: int = 8_000_000) -> DataFrame:
    """Writes the ids of all documents under `folder` and returns its manifest: (name, docs, tokens, first_token).

    The folder is one that all executors see, of a store that Spark and Arrow open (a shared path, HDFS, S3, GCS).
    """
    order, tie = fresh(docs, "order", "tie")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn(order, F.xxhash64("text")).withColumn(tie, F.monotonically_increasing_id())
    by = (F.col("doc_id").asc_nulls_last(), order, tie)

    def run(batches):
        from pyspark import TaskContext

        tokens, part = tokenizer(tokenizer_path), TaskContext.get().partitionId()
        fs, base = opened(f"{folder}/data")
        fs.create_dir(base, recursive=True)
        end, made = np.array([end_id], "<u4").tobytes(), 0

        def write(held):
            nonlocal made
            name, beside = f"{part:07d}-{made:05d}.dac", f"{base}/.{uuid.uuid4().hex}"
            made += 1
            with fs.open_output_stream(beside) as f:
                f.write(encode_file(held, end_id))
            fs.move(beside, f"{base}/{name}")
            return pa.RecordBatch.from_pydict({"name": [name], "docs": pa.array([len(held)], pa.int64()), "tokens": pa.array([sum(len(x) for _, x in held)], pa.int64())})

        held, size = [], 0
        for batch in arrow_slices(batches):
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                held.append((doc, np.frombuffer(tokens.ids(text) + end, "<u4")))
                size += len(held[-1][1])
                if size >= file_tokens:
                    yield write(held)
                    held, size = [], 0
        if held:
            yield write(held)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("doc_id", "text")
    map_arrow(ranged, run, "name string, docs long, tokens long").write.parquet(f"{folder}/files")
    spark = docs.sparkSession
    files = spark.read.parquet(f"{folder}/files")
    before = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files.withColumn("first_token", F.coalesce(F.sum("tokens").over(before), F.lit(0))).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_docs(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file) of every document, from the files that the manifest names."""
    manifest = spark.read.parquet(f"{folder}/manifest")

    def run(batches):
        fs, base = opened(f"{folder}/data")
        for batch in batches:
            for name, start in zip(batch["name"].to_pylist(), batch["first_token"].to_pylist()):
                with fs.open_input_file(f"{base}/{name}") as source:
                    file = TokenFile(source)
                    ids, first = file.docs()
                    crc = []
                    for a, b in _spans(first):
                        tokens = file.tokens(int(first[a]), int(first[b])).astype("<u4")
                        crc += [zlib.crc32(tokens[first[k] - first[a] : first[k + 1] - first[a]]) for k in range(a, b)]
                long = lambda x: pa.array(x, pa.int64())
                yield pa.RecordBatch.from_pydict({"doc_id": long(ids), "start": long(start + first[:-1]), "n_tokens": long(np.diff(first)), "ids_crc32": long(crc), "file": [name] * len(ids)})

    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return map_arrow(manifest.repartition(width, "name"), run, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def _spans(first: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Runs of documents of some `most` tokens."""
    a = 0
    while a < len(first) - 1:
        b = max(a + 1, int(np.searchsorted(first, first[a] + most, "right")) - 1)
        yield a, b
        a = b
