import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphloom.llm.cost_packing import TextTokenizer, pack, plan

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "a  b   c \n d\n\n  e ", "", "  ", "\n", " x", "it's  don't\tq   z", "<|endoftext|> a", "a\n \nb", "x \n", "日本 語　x", "a\x1c b",
    "é  !!  \n\n\n  9 '  's 's", "The whole of it. " * 3000, "x" * 5000, None,
]


def test_ids_equal_the_library():
    library, own = Tokenizer.from_file(PATH), TextTokenizer(PATH)
    for t in TEXTS:
        assert own.ids(t or "").tolist() == library.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 1_000_000 + "x", "\n" * 1_000_000, " \n" * 600_000, "word " * 250_000, "x" * 1_200_000, "日本" * 600_000], ids=range(6))
def test_long_texts(spark, text):
    want = np.array(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids + [0], "<u4")
    assert (TextTokenizer(PATH).ids(text) == want[:-1]).all()
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string").coalesce(1)
    out = pack(docs, PATH, keep_ids=True).where("doc_id = 1").orderBy("start").collect()
    assert [i for r in out for i in r["ids"]] == want.astype(int).tolist() and all(r["length"] == 1024 for r in out[:-2])


def plain_plan(rests, capacity):
    """The rule in plain words: the largest rest next, to the cheapest sequence with room; else the roomiest takes what fits."""
    n = -(-sum(size for _, size in rests) // capacity)
    used, cost, out = [0] * n, [0.0] * n, []
    left = [[size, i, key, 0] for i, (key, size) in enumerate(rests)]
    while left:
        top = max(left, key=lambda x: (x[0], -x[1]))
        left.remove(top)
        size, i, key, first = top
        fits = [s for s in range(n) if capacity - used[s] >= size]
        seq = min(fits, key=lambda s: (cost[s], s)) if fits else min(range(n), key=lambda s: (used[s], s))
        take = min(size, capacity - used[seq])
        out.append((key, first, take, seq, used[seq]))
        used[seq] += take
        cost[seq] += take + take * take / 1024
        if take < size:
            left.append([size - take, i, key, first + take])
    return out, cost


def test_plan_equals_the_plain_rule():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        rests = [(i, int(n)) for i, n in enumerate(rng.integers(1, [64, 1024, 400][seed % 3], 80))]
        assert plan(rests, 1024, 1.0, 1 / 1024) == plain_plan(rests, 1024)[0]


def test_costs_are_nearer_than_in_input_order():
    rng = np.random.default_rng(5)
    rests = [(i, int(n)) for i, n in enumerate(rng.integers(1, 600, 400))]
    _, cost = plain_plan(rests, 1024)
    fill, plain = 0, [0.0]
    for _, size in rests:  # next fit
        if fill + size > 1024:
            fill = 0
            plain.append(0.0)
        fill += size
        plain[-1] += size + size * size / 1024
    assert np.std(cost) < 0.5 * np.std(plain)


def test_plan_fills_and_balances():
    rng = np.random.default_rng(1)
    rests = [(i, int(n)) for i, n in enumerate(rng.integers(1, 1024, 500))]
    out = plan(rests, 1024, 1.0, 1 / 1024)
    used = {}
    for key, first, size, seq, offset in sorted(out, key=lambda x: (x[3], x[4])):
        assert offset == used.get(seq, 0)
        used[seq] = offset + size
    total = sum(n for _, n in rests)
    assert max(used.values()) <= 1024 and len(used) == -(-total // 1024)
    for key, n in rests:
        parts = sorted((f, s) for k, f, s, _, _ in out if k == key)
        assert parts[0][0] == 0 and sum(s for _, s in parts) == n
        assert all(a + s == b for (a, s), (b, _) in zip(parts, parts[1:]))


@pytest.mark.parametrize("window", [2, 4096])
def test_pieces_hold_every_id_once(spark, window):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "again"), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").coalesce(1)
    out = pack(docs, PATH, window_docs=window).toPandas()
    library = Tokenizer.from_file(PATH)
    for i, t in enumerate(TEXTS):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        own = out[out["doc_id"] == i].sort_values("start")
        times = 2 if i == 0 else 1
        assert own["length"].sum() == times * len(ids) and set(own["doc_tokens"]) == {len(ids)}
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for _, seq in out.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq["offset"].tolist() == [0, *seq["length"].cumsum().tolist()[:-1]] and seq["length"].sum() <= 1024
    assert out["doc_id"].isna().sum() == 1


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
