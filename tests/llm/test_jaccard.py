import itertools
import random

import corpus_pipeline
from graphloom.llm.jaccard_groups import groups


def brute_groups(texts, k=5):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    group = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a == b or 10 * len(a & b) >= 8 * len(a | b) > 0:
            group = [group[i] if g == group[j] else g for g in group]
    return group


def near_copies():
    random.seed(4)
    line = " ".join(f"shared{i}" for i in range(30))
    texts = []
    for b in range(40):
        words = [f"{random.choice('abcdefgh')}{random.randrange(3000)}" for _ in range(random.randint(60, 200))]
        texts.append(" ".join(words) + " " + line)
        for _ in range(random.randint(0, 5)):
            w = list(words)
            for _ in range(random.randint(1, 5)):
                w[random.randrange(len(w))] = f"changed{random.randrange(10**6)}"
            texts.append(" ".join(w) + " " + line)
    # a chain whose ends are unlike, and word order that only longer shingles see
    words = [f"k{i}" for i in range(100)]
    texts += [" ".join(words[i * 8 :] + [f"m{j}" for j in range(i * 8)]) for i in range(6)]
    return texts + [None, "", " ", "one two", "One  two", "one three"]


def test_groups_equal_brute_force_jaccard(spark):
    texts = near_copies()
    rows = list(enumerate(texts))
    random.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["group"] for r in groups(docs).collect()}
    want = brute_groups(texts)
    assert len(set(want)) < len(texts) - 50
    for i, j in itertools.combinations(range(len(texts)), 2):
        assert (got[i] == got[j]) == (want[i] == want[j]), (texts[i], texts[j])


def test_stage_drops_near_copies_at_jaccard_four_fifths(spark):
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, docs, "").collect())
    want = brute_groups(texts)
    assert kept == [i for i, g in enumerate(want) if g not in want[:i]]


def test_stage_chooses_survivors_by_row(spark):
    text = [" ".join(f"{k}{i}" for i in range(60)) for k in "abcdef"]
    near = text[1] + " more"
    rows = [(3, text[0], "x"), (3, text[0], "x"), (3, text[0], "y")]  # one id, one text
    rows += [(1, text[1], "x"), (7, near, "x"), (7, text[2], "x")]  # of id 7 only the near copy goes
    rows += [(None, text[3], "x"), (None, text[3], "x"), (None, text[4], "x"), (9, text[4], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [corpus_pipeline.dedup_stage(spark, d, "").collect() for d in (docs, docs.repartition(5))]
    want = [(3, text[0]), (1, text[1]), (7, text[2]), (None, text[3]), (9, text[4])]
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept[0]) == sorted((str(i), t) for i, t in want)
    assert sorted(map(str, kept[0])) == sorted(map(str, kept[1]))


def test_empty_table(spark):
    assert groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_set_with_many_pairs_is_compared_in_several_tasks(spark):
    """No task of the comparison of 1,500 near copies of one text gets a large part of it, though adaptive plans are off."""
    from pyspark.sql import functions as F

    from graphloom.llm import jaccard_groups
    from graphloom.llm.shared import row_hash

    words = [f"w{i}" for i in range(120)]
    docs = spark.createDataFrame([(i, " ".join(words[:100] + [f"x{i}"] + words[100:])) for i in range(1500)], "doc_id long, text string")
    rows = jaccard_groups.cut(jaccard_groups.measured(docs))
    node = {r["doc_id"]: r["node"] for r in rows.collect()}
    pairs = spark.createDataFrame([(node[0], node[i]) for i in range(1, 1500)], "a long, b long")
    assert docs.select(row_hash(docs)).distinct().count() == 1500
    spread = jaccard_groups.Spread(pairs, "a", 64)
    sides = spark.createDataFrame([(n,) for n in node.values()], "a long").distinct()
    with jaccard_groups.steady(spark):  # adaptive plans would put so few rows into one partition again
        met = spread.join(sides).withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    assert sum(r["count"] for r in met) == 1499 and max(r["count"] for r in met) < 1000
    found = jaccard_groups._similar(docs, rows, pairs, 5, 80)
    assert found.count() == 1499


def test_fingerprint_links_come_first_and_are_compared(spark, monkeypatch):
    """The covering fingerprints give the first pairs; only those that are similar as sets become links."""
    from graphloom.llm import jaccard_groups

    long = [" ".join(f"w{(i * i) % 997}" for i in range(2000)), " ".join(f"v{i}" for i in range(400))]
    texts = [long[0], long[0] + " end", long[0].upper(), long[1], long[1] + " " + long[1], None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked, similar = [], jaccard_groups._similar
    monkeypatch.setattr(jaccard_groups, "_similar", lambda d, r, pairs, *a: asked.append({tuple(x) for x in pairs.collect()}) or similar(d, r, pairs, *a))
    group = {r["doc_id"]: r["group"] for r in groups(docs).collect()}
    node = {r["doc_id"]: r["node"] for r in jaccard_groups.measured(docs).collect()}
    assert tuple(sorted((node[0], node[1]))) in asked[0]
    assert group[0] == group[1] == group[2] and group[3] == group[4] and len(set(group.values())) == 3
