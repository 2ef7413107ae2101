import hashlib
import math
import random

import numpy as np
import pytest

from graphloom.llm import vector_codes
from graphloom.llm.vector_codes import codebook, compress, label_errors, nearest


def brute(rows, parts, entries, rounds, scale=1024):
    """[(vec_id, label, codes, error)] in order of ids, and the codebooks, by plain loops over all entries."""
    ok = [(i, label, v) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok = sorted(ok, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    ok = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in ok if len(v) == len(ok[0][2])]
    dim = len(ok[0][2]) if ok else 0
    at = [dim * p // parts for p in range(parts + 1)]
    cut = [[v[a:b] for a, b in zip(at, at[1:])] for _, _, v in ok]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    best = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        codes = [[best(x, book)[1] for x, book in zip(v, books)] for v in cut]
        for p, book in enumerate(books):
            for k in range(len(book)):
                own = [v[p] for v, c in zip(cut, codes) if c[p] == k]
                if own:
                    book[k] = [sum(col) // len(own) for col in zip(*own)]
    last = [[best(x, book) for x, book in zip(v, books)] for v in cut]
    return [(i, label, [k for _, k in f], min(sum(d for d, _ in f), 2**63 - 1)) for (i, label, _), f in zip(ok, last)], books


def made(spark, rows, folder, kind="double", **how):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").selectExpr("*", "'x' as code", "1 as vector", "2 as error").repartition(3)
    out = compress(df, str(folder), **how)
    entries = [[[int(x) for x in row] for row in b.entries] for b in out.codebooks]
    wide = "u1" if not entries or len(entries[0]) <= 256 else "<u2"
    return [(r["vec_id"], r["label"], np.frombuffer(bytes(r["code"]), wide).tolist(), r["error"]) for r in out.rows.collect()], entries, out


def same(a, b):
    return sorted(map(str, a)) == sorted(map(str, b))


@pytest.mark.parametrize("dim,parts,entries,n", [(8, 4, 16, 400), (6, 4, 300, 700), (3, 4, 5, 40)])
def test_equals_brute_force(spark, tmp_path, dim, parts, entries, n):
    random.seed(dim)
    rows = [(i * 7 % 1009, [random.gauss(0, 1) / 256 for _ in range(dim)], i % 3 or None) for i in range(n)]
    got, books, _ = made(spark, rows, tmp_path, parts=parts, entries=entries, rounds=4)
    want, want_books = brute(rows, parts, entries, 4)
    assert same(got, want) and books == want_books


def test_ties_repeats_nulls_and_other_lengths(spark, tmp_path):
    random.seed(3)
    rows = [(i, [random.randint(-2, 2) / 1024 for _ in range(4)], None if i % 4 else 1) for i in range(200)]
    rows += rows[:50] + [(None, [0.0] * 4, 2), (5, None, 1), (6, [1.0, None, 0.0, 0.0], 1), (7, [math.nan] * 4, 1), (8, [math.inf] * 4, 1), (300, [], 1), (301, [1.0], 1), (9, [-0.0] * 4, 1)]
    got, books, out = made(spark, rows, tmp_path, parts=2, entries=20, rounds=3)
    want, want_books = brute(rows, 2, 20, 3)
    assert same(got, want) and books == want_books
    sums = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    assert {(r["label"], r["label_error"]) for r in label_errors(out.rows).collect()} == set(sums.items())
    assert label_errors(out.rows).count() == len(want)
    text = ",".join(str(x) for book in want_books for row in book for x in row)
    assert out.sha256() == hashlib.sha256(text.encode()).hexdigest()


def test_large_components_are_exact(spark, tmp_path):
    random.seed(4)
    rows = [(i, [random.choice([1e8, -3e20, 1.5, 0.1]) * random.random() for _ in range(4)], 1) for i in range(80)] + [(90, [1e308, 0.0, 0.0, 0.0], 1)]
    got, books, out = made(spark, rows, tmp_path, parts=2, entries=8, rounds=2)
    want, want_books = brute(rows[:-1], 2, 8, 2)
    assert same(got, want) and books == want_books
    assert label_errors(out.rows).head()["label_error"] == min(sum(r[3] for r in want), 2**63 - 1)


def test_small_and_empty_tables(spark, tmp_path):
    got, books, _ = made(spark, [(4, [0.5, 1.0], None)], tmp_path / "a", "float")
    assert got == [(4, None, [0, 0, 0, 0], 0)] and books == [[[]], [[512]], [[]], [[1024]]]
    got, books, out = made(spark, [(4, None, None)], tmp_path / "b")
    assert got == [] and books == [[]] * 4 and label_errors(out.rows).count() == 0
    got, _, _ = made(spark, [(1, [], 1), (2, [], 2)], tmp_path / "c")
    assert got == [(1, 1, [0] * 4, 0), (2, 2, [0] * 4, 0)]


def test_search_from_any_entry_finds_the_nearest():
    rng = np.random.default_rng(5)
    entries = rng.integers(-6, 7, (64, 3)).tolist()
    book, x = codebook(entries), rng.integers(-8, 9, (500, 3)).astype(float)
    d = ((x[:, None] - np.array(entries)[None]) ** 2).sum(axis=2)
    for start in (np.zeros(500, np.int64), np.full(500, 63), rng.integers(0, 64, 500)):
        entry, far = nearest(x, start, book)
        assert (entry == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()


def test_search_looks_at_few_entries_near_a_good_start(monkeypatch):
    rng = np.random.default_rng(6)
    entries = rng.integers(-4000, 4000, (256, 2))
    book, x = codebook(entries.tolist()), (entries[rng.integers(0, 256, 2000)] + rng.integers(-20, 20, (2000, 2))).astype(float)
    best = ((x[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    reach = 4 * ((x - entries[best]) ** 2).sum(axis=1)
    looked = [np.searchsorted(book.away[a], r, "right") for a, r in zip(best, reach)]
    assert np.mean(looked) < 3 and (nearest(x, best, book)[0] == best).all()
    assert vector_codes.STEP >= 1
