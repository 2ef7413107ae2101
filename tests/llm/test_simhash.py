import itertools
import random

import numpy as np
import xxhash

import pytest

from graphloom.llm.covering_simhash import components, covering_masks, fingerprint, fingerprint_links, near_duplicates
from graphloom.llm.shared import Spread


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\r\x0b\x0c" else c for c in low).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids):
    group = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 2:
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    least = {g: min((x for x, k in zip(ids, group) if k == g and x is not None), default=None) for g in group}
    return [least[g] for g in group]


def test_masks_cover_every_pair_of_bits():
    masks = [m & (2**64 - 1) for m in covering_masks()]
    assert len(masks) == 7
    for i, j in itertools.combinations_with_replacement(range(64), 2):
        assert any(not (m >> i & 1 or m >> j & 1) for m in masks)


def test_fingerprint_is_exact():
    random.seed(2)
    words = ["Alpha", "beta", "GAMMA", "été", "日本", "x"]
    for n in (0, 1, 2, 3, 4, 300):
        text = " \n\t".join(random.choice(words) for _ in range(n))
        assert fingerprint(text) == brute_fingerprint(text)
    assert fingerprint(None) == 0 and fingerprint("   ") == brute_fingerprint("   ")
    long = " ".join(random.choice(words) for _ in range(40_000))
    assert fingerprint(long) == brute_fingerprint(long)


def test_groups_equal_brute_force(spark):
    random.seed(3)
    base = [" ".join(random.choice("abcdefghijklmnopqrstuvwxyz") * random.randint(1, 4) for _ in range(80)) for _ in range(40)]
    texts = []
    for b in base:
        texts.append(b)
        words = b.split()
        for _ in range(random.randint(0, 6)):
            w = list(words)
            w[random.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += [base[0]] * 30 + [None, "", " ", "one", "one"]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(None, base[1], 7), (5, texts[5], 7)]
    random.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    out = near_duplicates(docs).collect()
    assert len(out) == len(rows)
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    ids = [i for i, _, _ in rows]
    want = sorted((str(i), f"{f:016x}", c) for i, f, c in zip(ids, fps, brute_components(fps, ids)))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in out) == want


def near_value_links(fps):
    """The plainer path: two values within two bits of each other meet at a value one bit from both."""
    meet = {}
    for f in fps:
        for value in [f, *(f ^ 1 << i for i in range(64))]:
            meet.setdefault(value, []).append(f)
    return [(f, min(own)) for own in meet.values() for f in own if f != min(own)]


def labels_of(nodes, links):
    label = {x: x for x in nodes}
    while True:
        new = dict(label)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("small_bucket", [1, 3, 256])
def test_links_of_buckets_equal_the_plainer_path(spark, small_bucket):
    random.seed(7)
    fps = set()
    for _ in range(60):
        f = random.getrandbits(64)
        for _ in range(random.choice([1, 2, 3, 12])):
            fps.add(f)
            f ^= 1 << random.randrange(64) | 1 << random.randrange(64) | (1 << random.randrange(64) if random.random() < 0.3 else 0)
    hot = random.getrandbits(64)
    fps |= {hot ^ 1 << i ^ 1 << j for i, j in itertools.combinations(range(24), 2)}
    signed = {x: x - (1 << 64) if x >> 63 else x for x in fps}
    distinct = spark.createDataFrame([(x,) for x in signed.values()], "fp long")
    got = [(r["fp"], r["hub"]) for r in fingerprint_links(distinct, small_bucket=small_bucket).collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 24 for a, b in got)
    want = labels_of(signed.values(), [(signed[a], signed[b]) for a, b in near_value_links(fps)])
    assert labels_of(signed.values(), got) == want


def test_wider_radius(spark):
    random.seed(8)
    fps = {random.getrandbits(63) for _ in range(30)}
    fps |= {f ^ sum(1 << b for b in random.sample(range(63), n)) for f in list(fps) for n in (3, 4, 5)}
    got = [(r["fp"], r["hub"]) for r in fingerprint_links(spark.createDataFrame([(x,) for x in fps], "fp long"), radius=4).collect()]
    want = [(a, b) for a, b in itertools.combinations(fps, 2) if bin(a ^ b).count("1") <= 4]
    assert labels_of(fps, got) == labels_of(fps, want)


def test_spread_join(spark):
    many = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)] + [(None, 5)], "k long, x long")
    side = spark.createDataFrame([(i, i * 10) for i in range(200)], "k long, y long")
    for how in ("inner", "left"):
        want = sorted(map(str, many.join(side, "k", how).collect()))
        assert sorted(map(str, Spread(many, "k", 7).join(side, how).collect())) == want
        assert sorted(map(str, Spread(many, "k").join(side, how).collect())) == want


def test_long_texts(spark):
    rows = [(1, " \n" * 700_000), (2, ""), (3, "Word " * 300_000), (4, "x" * 1_500_000), (5, None)]
    out = {r["doc_id"]: r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i]["fingerprint"] == f"{brute_fingerprint(t):016x}" for i, t in rows)
    assert out[1]["component_id"] == out[2]["component_id"] == out[5]["component_id"] == 1


def test_long_chain_is_one_component(spark):
    chain = spark.range(0, 300).selectExpr("id as a", "id + 1 as b")
    out = components(chain, "a", "b").toPandas()
    assert len(out) == 301 and set(out["label"]) == {0}


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_planted_bits(spark):
    assert np.uint64(fingerprint("a b c")) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_size_estimates_do_not_multiply_with_the_rounds(spark):
    """A checkpoint keeps the size estimated for its plan; a chain takes many rounds of joins, each on the one before."""
    from graphloom.llm.covering_simhash import components
    from graphloom.llm.jaccard_groups import _relabelled

    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    labels = components(chain, "a", "b")
    again = _relabelled(labels, spark.createDataFrame([(20, 100), (100, 101)], "a long, b long"))
    for found in (labels, again):
        assert {r["label"] for r in found.collect()} == {0}
        assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() <= 64
    assert again.count() == 23
