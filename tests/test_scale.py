"""Steps that must not go to few tasks, run twice or be broadcast whole, whatever sizes Spark estimates."""

import dataclasses
import re

from pyspark.sql import functions as F

from graphloom.operators import lookups, walks
from graphloom.plans import demo_views
from graphloom.plans.demo_sources import sources
from graphloom.plans.raw import raw_tables
from graphloom.queries import split_delimiters
from graphloom.sources.parse import parse_files, parsed_only
from graphloom.sources.scan import dealt

SF = "/root/testdata/sf0.1"


def test_many_small_names_go_to_many_tasks(spark):
    assert dealt(spark.range(1000), "id").rdd.getNumPartitions() == 16 and dealt(spark.range(3), "id").rdd.getNumPartitions() == 1
    assert dealt(spark.range(0), "id").count() == 0
    assert sources(spark, SF).rdd.getNumPartitions() >= 32  # a thousand suppliers, whose table is read by one task


def test_files_are_parsed_once_and_not_broadcast(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for pdf in frames:
            seen.add(len(pdf))
            yield pdf

    parsed = parsed_only(parse_files(sources(spark, SF)))
    n = parsed.count()
    raw = raw_tables(parsed.mapInPandas(count, parsed.schema))
    assert seen.value == n == raw.files.count()
    rows = raw.files.select("file_no").orderBy("file_no").collect()
    assert [r["file_no"] for r in rows] == list(range(1, n + 1))


def test_totals_do_not_move_what_a_walk_shows(spark):
    """Counts ask only whether peers are there: names and paths stay where they are."""
    totals = walks.walk_totals(demo_views.index_views(spark, "/root/testdata/sf0.001"), "calls")
    read = re.findall(r"ReadSchema: (\S+)", totals._jdf.queryExecution().executedPlan().toString())
    assert read and not any(name in x for x in read for name in ("c_name", "r_name", "o_orderpriority")), read


def largest_part(spark, make):
    """The share of the rows that the largest of 8 partitions gets, where plans are not adapted to it."""
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        rows = [r["count"] for r in make().groupBy(F.spark_partition_id().alias("part")).count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return max(rows) / sum(rows)


def test_calls_without_a_known_end_do_not_meet_in_one_task(spark):
    index = demo_views.index_views(spark, "/root/testdata/sf0.01")
    index = dataclasses.replace(index, edges_calls=index.edges_calls.repartition(8).localCheckpoint())
    assert index.edges_calls.where("callee_id is null").count() > 0.2 * index.edges_calls.count()
    assert largest_part(spark, lambda: walks.walk_rows(index, "calls", "out")) < 0.2


def test_nodes_without_an_owner_do_not_meet_in_one_task(spark):
    index = demo_views.index_views(spark, "/root/testdata/sf0.01")
    index = dataclasses.replace(index, nodes=index.nodes.repartition(8).localCheckpoint(), files=index.files.localCheckpoint())
    assert index.nodes.where("owner_id is null").count() > 0.2 * index.nodes.count()
    files = index.files.withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(799)))).withColumn("file_id", F.concat("file_id", F.col("of").cast("string"))).drop("of")
    spread = index.nodes.withColumn("file_id", F.concat("file_id", F.pmod(F.xxhash64("node_id"), F.lit(800)).cast("string")))
    many = dataclasses.replace(index, nodes=spread, files=files)
    assert largest_part(spark, lambda: lookups.get_node(many)) < 0.2


def test_parts_of_a_text_are_counted_where_it_is(spark, tmp_path):
    rows = [(1, "a.b a"), (2, "..."), (3, None), (4, "x"), (4, "x y/z"), (None, "p q"), (None, "q:r"), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/a/documents.parquet")
    got = {tuple(r) for r in split_delimiters(spark, f"{tmp_path}/a").collect()}
    assert got == {(1, 3, 2), (4, 4, 3), (None, 4, 3)}
    spark.createDataFrame(rows[:4], "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    counted = split_delimiters(spark, f"{tmp_path}/b")
    assert {tuple(r) for r in counted.collect()} == {(1, 3, 2), (4, 1, 1)}
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()


def test_parsed_files_are_handed_on_as_arrow(spark):
    """Nested rows would else become objects of pandas, one by one."""
    files = spark.createDataFrame([("k", "a.py", "python", b"def f(x: int):\n    g(x)\n"), ("j", "B.java", "java", b"class B extends A { }"), ("e", "e.py", "python", b"def (")], "key string, rel_path string, lang string, content binary")
    parsed = parse_files(files)
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    rows = {r["key"]: r for r in parsed.collect()}
    assert not rows["k"]["error"] and [c["callee_name"] for c in rows["k"]["calls"]] == ["g"] and rows["j"]["objects"][0]["bases"][0]["name"] == "A"
    assert rows["e"]["error"] and rows["e"]["package"] == "" and rows["e"]["calls"] is None
