import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm.entropy_mix import apply_mix, mix, rates, targets


def brute_targets(sizes: dict, weights=(5, 2, 1), budget=1.5):
    """Targets by sharing again and again what is above twice a source's size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, pool = {}, set(order), budget * sum(sizes.values())
    while left:
        total = sum(weight[s] for s in left)
        share = {s: pool * weight[s] / total for s in left}
        over = {s for s in left if share[s] >= 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2 * sizes[s]
            pool -= 2 * sizes[s]
        left -= over
    return out


def documents(seed=7):
    random.seed(seed)
    rows, i = [], 0
    for source, n in (("b", 300), ("a", 60), ("é", 40), ("Z", 25), (None, 30), ("z", 8)):
        for _ in range(n):
            rows.append((i, " ".join(["w"] * int(random.lognormvariate(4, 1))), source, "x"))
            i += 1
    return rows + [(i, None, "a", "x"), (i + 1, " \n", None, "x"), (None, "one two", "b", "x"), (5, rows[5][1], "b", "x"), (5, rows[5][1], "b", "x")]


def test_targets_and_taken(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    out = mix(docs).collect()
    assert len(out) == len(rows)
    sizes, of = {}, {}
    for i, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    ids = {i: s for i, _, s, _ in rows}
    taken = {}
    for r in out:
        s = ids[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] = taken.get(s, 0) + r["taken"]
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], rel=0.03)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, mix(docs.repartition(7)).collect())) == sorted(map(key, out))


def test_rates_are_exponential_tilts(spark):
    """Expected copies solve the dual: log rate is proportional to size below the cap."""
    from graphloom.llm.entropy_mix import tilts

    sizes = spark.createDataFrame([(0, s, n) for s, n in ((10, 30), (50, 20), (400, 5))], "source_no long, size long, n long")
    goals = spark.createDataFrame([(0, 3300, 4200.0)], "source_no long, source_size long, target double")
    r = tilts(sizes, goals).first()
    rate = lambda s: min(2.0, math.exp(r["tilt"] * s / r["mean"]))
    assert sum(n * s * rate(s) for s, n in ((10, 30), (50, 20), (400, 5))) == pytest.approx(4200, rel=1e-6)


def test_apply_repeats_rows(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n string")
    out = apply_mix(docs)
    assert out.columns == docs.columns
    words = {r["source"]: r["n_words"] for r in out.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n_words")).collect()}
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    for s in sizes:
        assert words[s] == pytest.approx(want[s], rel=0.06)


def test_rows_of_one_id_share_what_the_mix_takes(spark):
    rows = [(i, f"{k}{i} " * (20 + i % 30), "ab"[i % 2]) for i in range(150) for k in "xyz"[: 1 + i % 3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {r["doc_id"]: r["t"] for r in mix(docs).groupBy("doc_id").agg(F.sum("taken").alias("t")).collect() if r["t"]}
    seen = []
    for dealt in (docs, docs.repartition(7)):
        out = apply_mix(dealt).collect()
        got = {}
        for r in out:
            got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
        assert got == want
        seen.append(sorted(map(str, out)))
    assert seen[0] == seen[1]


def test_empty_and_wordless_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mix(spark.createDataFrame([], schema)).count() == 0
    assert [r["taken"] for r in mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], schema)).collect()] == [0, 0]


def test_targets_without_sources(spark):
    rows = spark.createDataFrame([(0, 100), (1, 10), (2, 1)], "source_no long, source_size long")
    got = {r["source_no"]: r["target"] for r in targets(rows).collect()}
    want = brute_targets({"a": 100, "b": 10, "c": 1})
    assert [got[i] for i in range(3)] == pytest.approx([want[s] for s in "abc"])
    assert rates(spark.createDataFrame([], "doc_id long, text string, source string"))[0].count() == 0


def test_copies_equal_plain_error_diffusion(spark):
    """Beside a plain version: tilts by bisection, then rounding that carries what it owes from document to document."""
    rows = documents(9) + [(9_000_000, "long " * 300_000, "Z", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in mix(docs).collect())
    of: dict = {}
    for i, text, source, _ in rows:
        of.setdefault(source, []).append((i, len((text or "").split())))
    goals = brute_targets({s: sum(n for _, n in own) for s, own in of.items()})
    want = []
    for source, own in of.items():
        total, mean = sum(n for _, n in own), sum(n for _, n in own) / len(own)
        rate = lambda n, t: 2.0 if t * n / mean >= math.log(2) else math.exp(t * n / mean)  # noqa: E731, B023
        lo, hi = -1e4, 1e6
        if goals[source] >= 2 * total * (1 - 1e-12):
            lo = hi = math.inf
        else:
            for _ in range(400):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if sum(n * rate(n, mid) for _, n in own) < goals[source] else (lo, mid)
        owed, copy_no = 0.0, {}
        for i, n in sorted(own, key=lambda d: (-d[1], d[0] is not None, d[0] or 0)):
            r = (2.0 if math.isinf(hi) else rate(n, hi)) if total else 1.0
            low = int(r)
            copies = low + (r - low > 0 and owed + (r - low) * n >= 0.5 * n)
            owed += (r - copies) * n
            want.append((str(i), n, copies * n))
            copy_no[i] = copies
    off = sum(a != b for a, b in zip(got, sorted(want)))
    assert len(got) == len(want) and off <= 2  # a sum that falls on the edge may be rounded otherwise
