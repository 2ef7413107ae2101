"""Loops over few rows don't run a task for each shuffle partition at each of their steps."""

import pytest
from pyspark.sql import functions as F

from graphloom.llm import jaccard_groups, shared
from graphloom.llm.covering_simhash import components
from graphloom.llm.entropy_mix import apply_mix


@pytest.fixture
def wide(spark):
    """As where Spark doesn't join small partitions again."""
    own = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield 61
    for k, v in old.items():
        spark.conf.set(k, v)


def tasks(spark, group, action):
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    out = action()
    sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return out, sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)


def test_few_rows_go_to_few_partitions_and_none_is_lost(spark, wide, monkeypatch):
    few = shared.gathered(spark.range(1000).repartition(wide, "id"))
    assert few.rdd.getNumPartitions() == 1 and sorted(r.id for r in few.collect()) == list(range(1000))
    monkeypatch.setattr(shared, "GATHER", 300)
    assert shared.gathered(spark.range(1000).repartition(wide, "id")).rdd.getNumPartitions() == 4
    monkeypatch.setattr(shared, "FEW", 999)
    many = shared.gathered(spark.range(1000).repartition(wide, "id"))
    assert many.rdd.getNumPartitions() == wide and many.count() == 1000
    none = shared.gathered(spark.range(1000).repartition(wide, "id").where("id < 0"))
    assert none.count() == 0 and none.columns == ["id"]


def test_components_of_few_links(spark, wide):
    links = spark.createDataFrame([(i, i + 1) for i in range(60) if i % 10], "a long, b long").repartition(wide, "a")
    found, n = tasks(spark, "components", lambda: components(links, "a", "b").collect())
    want = {i: 10 * ((i - 1) // 10) + 1 for i in range(1, 61)}
    assert {r.node: r.label for r in found} == want
    assert n < 20 * wide, n


def test_a_group_of_near_copies_and_a_mix(spark, wide):
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(words[:k] + ["x"] + words[k + 1 :]) for k in range(40)] + [" ".join(f"v{i}x{k}" for k in range(30)) for i in range(20)]
    docs = spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    found, n = tasks(spark, "groups", lambda: jaccard_groups.groups(docs).collect())
    by = {}
    for r in found:
        by.setdefault(r.group, []).append(r.doc_id)
    assert sorted(map(sorted, by.values())) == [list(range(40))] + [[i] for i in range(40, 60)]
    assert n < 100 * wide, n
    got, n = tasks(spark, "mix", lambda: apply_mix(docs).groupBy().agg(F.sum(F.size(F.split("text", " ")))).first()[0])
    assert 0.9 * 1.5 < got / sum(len(t.split()) for t in texts) < 1.1 * 1.5
    assert n < 30 * wide, n
