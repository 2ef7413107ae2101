import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import blockmax_search
from graphloom.llm.blockmax_search import BLOCK, Range, Tile, build, save, search, terms

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    """By scoring every document for every item."""
    held = [(i, Counter(t)) for i, text in docs if (t := plain_terms(text))]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for t, f in df.items()}
    own: dict = {}
    for i, text in items:
        own.setdefault(i, set()).update(plain_terms(text))
    out = []
    for item, asked in own.items():
        found = []
        for doc, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            if s := sum(w[t] * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked if t in c):
                found.append((-s, doc is None, doc or 0))
        out += [(item, r + 1, None if gone else doc, -s) for r, (s, gone, doc) in enumerate(sorted(found)[:k])]
    return out


def text_of(rng, n):
    return " ".join(rng.choices([f"w{int(rng.paretovariate(0.5))}" for _ in range(60)], k=n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    docs = [(i * 3, text_of(rng, rng.randint(1, 60))) for i in range(400)]
    docs += [(5000 + i, "The same Text, the SAME text") for i in range(90)] + [(5001, "The same Text, the SAME text")] * 3
    docs += [(7000, None), (7001, ""), (7002, " -- \n!"), (None, "w1 w2 same"), (None, "w1 w2 same"), (7003, "w1 " * 30_000), (7004, "é́É w1_w2 ſame x 漢字")]
    items = [(i, text_of(rng, rng.randint(1, 30))) for i in range(25)] + [(90, "the SAME"), (91, None), (92, "..."), (93, "nowhere"), (94, "w1"), (None, "w2 É"), (95, "w1 w1"), (95, "same w2"), (96, "É ſame x w1 漢字")]
    return docs, items


@pytest.fixture(scope="module")
def frames(spark, rows):
    docs, items = rows
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as terms", "'x' as range").repartition(3)
    return d, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as rank")


@pytest.mark.parametrize("range_docs,range_words,seeds,tile", [(512, 150_000, 4, 100_000), (70, 500, 1, 40), (1, 1, 2, 100_000)])
def test_equals_brute_force(spark, tmp_path, rows, frames, range_docs, range_words, seeds, tile):
    index = save(build(frames[0], range_docs, range_words), str(tmp_path / "index"))
    got = [tuple(r) for r in search(index, frames[1], 50, seeds, tile).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(*rows, 50)))


def test_terms():
    for text in ("", None, "Ab-c\x7fd_E9\x00é́É ſ x İ 漢字\U0001f600.", "a`b{c@d[e/f:g"):
        assert [t.decode() for t in terms(text)] == plain_terms(text)


def test_bounds_hold_and_blocks_are_skipped(spark, tmp_path, rows, frames, monkeypatch):
    rng = random.Random(8)
    topics = [[f"t{k}x{j}" for j in range(30)] for k in range(40)]
    docs = [(i, " ".join(rng.choices(topics[i // 100], k=20) + ["and"] * rng.randint(1, 9))) for i in range(4000)]
    items = [(k, " ".join(topics[k][:6]) + " and") for k in range(40)]
    index = save(build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)), str(tmp_path / "index"))
    assert sorted(tuple(r) for r in search(index, spark.createDataFrame(items, "item_id long, text string"), 10).collect()) == sorted(brute(docs, items, 10))
    tile = Tile.of([(i, [*dict.fromkeys(terms(t))]) for i, t in items])
    tile.n, tile.total = 4000, sum(len(terms(t)) for _, t in docs)
    df = Counter(t for _, text in docs for t in set(terms(text)))
    tile.weights = np.array([blockmax_search.weight(df[t], 4000) for t in tile.vocabulary], np.int64)
    least = np.array([sorted((s for i, _, _, s in brute(docs, items, 10) if i == k))[0] for k in range(40)])
    blocks = needed = 0
    for row in index.collect():
        held = Range(row.asDict(), tile)
        bounds = held.bounds()
        held.open()
        blocks += bounds.size
        needed += int((bounds >= least[:, None]).sum())
        for item in range(0, 40, 5):
            for block in range(bounds.shape[1]):
                assert held.scores(item, block).max() <= bounds[item, block]
    assert blocks >= 40 * 4000 // BLOCK and needed < blocks / 8  # of each item's blocks few can hold a hit


def test_empty_sides(spark, tmp_path, frames):
    none = frames[0].limit(0)
    index = save(build(none), str(tmp_path / "a"))
    assert search(index, frames[1]).count() == 0
    index = save(build(frames[0]), str(tmp_path / "b"))
    assert search(index, frames[1].limit(0)).count() == 0 and search(index, frames[1].where("item_id = 91")).count() == 0
