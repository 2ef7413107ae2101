import collections
import random
import zlib

from graphloom.llm.kd_shard import kd_leaves, shards, write_shards


def rows():
    random.seed(8)
    out = []
    for i in range(4000):
        source = "hot" if i % 3 else f"s{i % 17}"
        out.append((i, "x" * random.randint(0, 400), random.choice(["en", "de", None]), source, i))
    return out + [(i, "same text", "en", "hot", 1) for i in range(5000, 7000)] + [(7, None, None, None, 1), (None, "é", "en", "hot", 2)] + [(9, "twice", "en", "hot", 2)] * 50


def test_bytes_are_near_equal_and_slots_gapless(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, size long")
    out = shards(docs).toPandas()
    assert len(out) == len(data) and set(out["law"]) == {"bytes"} and out["grown_shard"].isna().all()
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in data)
    assert sorted((str(i) if i == i and i is not None else "None", s, c) for i, s, c in zip(out["doc_id"].astype("Int64").astype(object).where(out["doc_id"].notna(), None), out["size"], out["text_crc32"])) == want
    by = out.groupby("shard")["size"].sum()
    assert list(by.index) == list(range(40)) and by.max() < 1.05 * by.mean() and by.min() > 0.95 * by.mean()
    for _, s in out.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    again = shards(docs.repartition(9)).toPandas()
    cols = ["doc_id", "text_crc32", "shard", "slot"]
    key = lambda df: sorted(map(str, df[cols].itertuples(index=False)))
    assert key(again) == key(out)


def test_few_rows_and_none(spark):
    schema = "doc_id long, text string, lang string, source string"
    out = shards(spark.createDataFrame([(1, "a", "en", "s"), (2, "b", "en", "s"), (3, "c", None, None)], schema)).toPandas()
    assert len(out) == 3 and out["shard"].between(0, 39).all()
    assert shards(spark.createDataFrame([], schema)).count() == 0


def test_written_files_hold_the_documents(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s") for i in range(200)], "doc_id long, text string, lang string, source string")
    write_shards(docs, shards(docs, 4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.select("shard").distinct().count() == 4


def test_written_files_hold_repeated_rows_once(spark, tmp_path):
    rows = [(5, "twice", "en", "s", k % 3) for k in range(700)] + [(None, "t", None, None, k) for k in range(300)] + [(i, f"t{i % 7}", "en", f"s{i % 3}", 1) for i in range(400)] * 2 + [(9, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, nth int").repartition(6)
    docs.write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    placed = shards(docs, 7)
    write_shards(docs, placed, str(tmp_path / "out"))
    back = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(map(str, (r[:5] for r in back))) == sorted(map(str, rows))
    places = collections.Counter((str(r["doc_id"]), r["text_crc32"], r["shard"]) for r in placed.collect())
    assert places == collections.Counter((str(r[0]), zlib.crc32((r[1] or "").encode()), r[5]) for r in back)


def plain_tree(rows, dims, leaves):
    """{tie: leaf} by sorting: rows are (tie, weight, values)."""
    span = 1 << 31
    scale = [max(max(r[2][d] for r in rows) - min(r[2][d] for r in rows), 1e-300) for d in range(dims)]
    out = {}

    def split(own, first, n):
        if n == 1 or not own:
            out.update((r[0], first) for r in own)
            return
        ends = [(min(r[2][d] for r in own), max(r[2][d] for r in own)) for d in range(dims)]
        wide = max(range(dims), key=lambda d: (ends[d][1] - ends[d][0]) / scale[d])
        lo, hi = ends[wide]

        def place(r):
            unit = (r[2][wide] - lo) / (hi - lo) if hi > lo else 0.0
            return min(int(unit * span), span - 1) * span + ((r[0] & (2**64 - 1)) >> 33)

        own = sorted(own, key=place)
        goal, left, k = sum(r[1] for r in own) * (n // 2) / n, 0, 0
        while k < len(own) and left + own[k][1] < goal:
            left += own[k][1]
            k += 1
        if goal - left > left + own[k][1] - goal:
            k += 1
        split(own[:k], first, n // 2)
        split(own[k:], first + n // 2, n - n // 2)

    split(rows, 0, leaves)
    return out


def test_tree_equals_plain_recursion(spark):
    random.seed(12)
    rows = [(random.getrandbits(64) - 2**63, random.randint(1, 50), (float(random.randint(0, 3)), random.random(), float(i))) for i in range(500)]
    df = spark.createDataFrame([(t, w, *v) for t, w, v in rows], "tie long, w long, a double, b double, c double")
    for leaves in (2, 5, 12):
        got = {r["tie"]: r["leaf"] for r in kd_leaves(df, ["a", "b", "c"], "w", "tie", leaves, tolerance=0.0).collect()}
        assert got == plain_tree(rows, 3, leaves)


def test_long_texts(spark):
    rows = [(1, " \n" * 700_000, "en", "s"), (2, "x" * 1_500_000, "en", "s"), (3, "é", "en", "s"), (4, None, "en", "s")]
    out = {r["doc_id"]: r for r in shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 2).collect()}
    assert [out[i]["size"] for i in range(1, 5)] == [1_400_016, 1_500_016, 18, 16]
    assert all(out[i]["text_crc32"] == zlib.crc32((t or "").encode()) for i, t, _, _ in rows)
