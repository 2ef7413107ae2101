import math
import random

import pytest

from graphloom.llm.topk_search import top_k


def brute(rows, queries, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if queries(i)}):
        found = []
        for vector in [v for i, v in ok if i == q]:
            found += [(-sum(a * b for a, b in zip(vector, v)), i) for i, v in ok if i != q and len(v) == len(vector)]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])]
    return out


@pytest.mark.parametrize("tile", [3, 4096])
def test_equals_brute_force(spark, tile):
    random.seed(10)
    rows = [(i, [float(random.randint(-2, 2)) / 4 for _ in range(6)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [math.nan] * 6), (304, [math.inf] * 6), (None, [0.0] * 6), (400, [1.0, 2.0]), (401, [0.5, 0.25]), (500, []), (7, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score").repartition(3)
    got = top_k(df.where("vec_id % 100 = 0"), df, 10, tile_rows=tile).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(brute(rows, lambda i: i % 100 == 0, 10))


def test_large_components_are_exact(spark):
    rows = [(0, [1e6, 3.0]), (1, [2e6, 1.0 / 3]), (2, [2e6 + 1 / 1024, -7.0]), (3, [2e6, 1.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k(df.where("vec_id = 0"), df, 5).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(brute(rows, lambda i: i == 0, 5))


def test_components_beyond_a_double_take_no_part(spark):
    rows = [(0, [1e306, 1.0]), (1, [1.0, 1e305]), (2, [1.0, 2.0]), (100, [3.0, 1.0]), (3, [-1e306, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in top_k(df.where("vec_id % 100 = 0"), df, 5).collect()]
    assert sorted(got) == [(100, 1, 2**63 - 1), (100, 2, 5 * 1024 * 1024)]


def test_empty(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    assert top_k(df.limit(0), df).count() == 0 and top_k(df, df.limit(0)).count() == 0 and top_k(df, df).count() == 0
