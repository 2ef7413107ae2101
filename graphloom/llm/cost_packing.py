"""Cost-balanced packing of tokenized documents into sequences of fixed length.

A document of L tokens is cut into full pieces, each a sequence of its own, and a rest. The cost of a piece is
estimated as `linear * L + quadratic * L^2` (attention stays within a piece). Within a window of documents as many
sequences are opened as the rests need tokens; the rests, in descending order of cost, each go to the sequence of
lowest cost that still has room. A rest that fits nowhere fills the roomiest sequence and its remainder goes on as
a shorter piece, so a window pads less than one sequence in all.

Windows are taken from the input's own partitions, so nothing is shuffled and no key can gather rows in one task.
A window holds at most `window_docs` documents and a bounded number of characters.

Defined results: a null text counts as empty; an empty document is the end token alone; a text of any length is
tokenized whole, blank or not, and cut into full sequences and a rest; repeated rows are packed one by one; equal costs
go to the sequence opened first, equal sizes in the order of the rows; a null id is kept as null; extra columns are ignored; an empty table gives no rows. The result depends
on the order of rows in a partition, so a retried task repeats it where the input is a file scan or a checkpoint.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_texts

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)

#: White space on which regex engines may differ, and the vocabulary's special token: such texts go the plain way.
_RARE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|<\\|endoftext\\|>")
#: Fixed value: the byte-level pre-tokenization pattern of this public vocabulary.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TextTokenizer:
    """Token ids of whole texts from a byte-level BPE file of the tokenizers library.

    The file's vocabulary is handed to a second engine that merges bytes in order of rank. It gives the same ids in a
    third of the time (the tests compare them); texts with rare white space or a special token take the library itself,
    and so do those that the engine refuses, as its pattern has a bounded stack for long runs of white space.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if all(c in byte_of for c in t) and t != "<|endoftext|>"}
        self.engine = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if not _RARE.search(text):
            try:
                return self.engine.encode_to_numpy(text, disallowed_special=())
            except ValueError:
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


def plan(rests: list[tuple[int, int]], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(key, tokens) pieces to (key, first token, tokens, sequence, offset); sequences number from 0."""
    n = -(-sum(size for _, size in rests) // capacity)
    cost = np.zeros(n)
    room = np.full(n, capacity)
    left = [(-size, i, key, 0) for i, (key, size) in enumerate(rests)]
    heapq.heapify(left)
    out = []
    while left:
        minus, i, key, first = heapq.heappop(left)
        size = -minus
        seq = int(np.where(room >= size, cost, np.inf).argmin())
        if room[seq] < size:
            seq = int(room.argmax())
            heapq.heappush(left, (int(room[seq]) - size, i, key, first + int(room[seq])))
            size = int(room[seq])
        out.append((key, first, size, seq, capacity - int(room[seq])))
        room[seq] -= size
        cost[seq] += linear * size + quadratic * size * size
    return out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 1024,
    end_id: int = 0,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
    window_docs: int = 4096,
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces of the documents with their sequence and offset; `keep_ids` adds the token ids of each piece."""
    schema = SCHEMA + (", ids array<int>" if keep_ids else "")

    def run(frames):
        tokens = TextTokenizer(tokenizer_path)
        context = TaskContext.get()
        made = (context.partitionId() if context else 0) << 36

        def flush(held):
            nonlocal made
            rows = []
            add = lambda doc, ids, start, length, seq, offset: rows.append(
                (doc, start, length, zlib.crc32(ids[start : start + length]), len(ids), seq, offset)
                + ((ids[start : start + length],) if keep_ids else ())
            )
            rests = []
            for k, (doc, ids) in enumerate(held):
                full = len(ids) // capacity * capacity
                for start in range(0, full, capacity):
                    add(doc, ids, start, capacity, made, 0)
                    made += 1
                if len(ids) > full:
                    rests.append((k, len(ids) - full))
            top = 0
            for k, first, size, seq, offset in plan(rests, capacity, linear, quadratic):
                doc, ids = held[k]
                add(doc, ids, len(ids) // capacity * capacity + first, size, made + seq, offset)
                top = max(top, seq + 1)
            made += top
            cols = [c.split()[0] for c in schema.split(", ")]
            out = pd.DataFrame(rows, columns=cols)
            out["doc_id"] = out["doc_id"].astype("Int64")
            return out

        held, size = [], 0
        for pdf in frames:
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                ids = np.append(tokens.ids(text or ""), np.uint32(end_id))
                held.append((None if pd.isna(doc) else int(doc), ids))
                size += len(ids)
            if len(held) >= window_docs or size > 8_000_000:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)
