from datetime import datetime

from graphloom.llm.url_lists import RESULTS, judge

DAY = lambda n: datetime(2024, 1, n)
EVENTS = [
    ("bad.com", "block", DAY(5)), ("bad.com", "drop", DAY(10)), ("bad.com", "block", DAY(20)), ("good.bad.com", "allow", DAY(1)),
    ("bad.com/ok/", "allow", DAY(6)), ("tie.org", "allow", DAY(3)), ("tie.org", "block", DAY(3)), (None, "block", DAY(1)), ("x.y", None, DAY(1)),
]
CAPTURES = [
    ("http://bad.com/a", DAY(4), "none", None), ("http://bad.com/a", DAY(5), "block", "bad.com"), ("http://www.BAD.com:80/a", DAY(9), "block", "bad.com"),
    ("http://bad.com/a", DAY(10), "none", None), ("http://bad.com/a", DAY(25), "block", "bad.com"), ("https://good.bad.com/", DAY(7), "allow", "good.bad.com"),
    ("http://bad.com/ok/page", DAY(7), "allow", "bad.com/ok/"), ("http://bad.com/okay/page", DAY(7), "block", "bad.com"), ("http://notbad.com/", DAY(7), "none", None),
    ("http://tie.org", DAY(3), "block", "tie.org"), ("http://user:pw@bad.com?x=/ok/", DAY(7), "block", "bad.com"), (None, DAY(7), "none", None),
    ("", DAY(7), "none", None), ("not a url", DAY(7), "none", None), ("http://bad.com/a", None, "none", None), ("http://bad.com/" + "p/" * 3000, DAY(7), "block", "bad.com"),
    ("http://bad.com./x", DAY(7), "block", "bad.com"),
]


def test_entries_active_at_fetch_time_decide(spark):
    events = spark.createDataFrame(EVENTS, "pattern string, verdict string, dated timestamp")
    rows = [(i, u, t, "own") for i, (u, t, _, _) in enumerate(CAPTURES)] * 2
    captures = spark.createDataFrame(rows, "id int, url string, fetched_at timestamp, verdict string").withColumnRenamed("id", "own_url")
    out = judge(captures, events)
    assert out.columns == ["own_url", "url", "fetched_at", *RESULTS]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        _, _, verdict, pattern = CAPTURES[r["own_url"]]
        assert (r["verdict"], r["pattern"], r["blocked"]) == (verdict, pattern, verdict == "block"), r


def test_long_urls(spark):
    events = spark.createDataFrame([*EVENTS, ("bad.com/" + "q/" * 5, "allow", DAY(6)), ("c.d", "block", DAY(1))], "pattern string, verdict string, dated timestamp")
    urls = ["http://bad.com/" + "q/" * 100_000, "http://" + "a." * 100_000 + "c.d/x", "http://c.d/" + "z" * 1_500_000, " " * 1_200_000, "http://bad.com/" + "q/" * 4 + "end"]
    captures = spark.createDataFrame([(i, u, DAY(7)) for i, u in enumerate(urls)], "id int, url string, fetched_at timestamp")
    got = {r["id"]: (r["verdict"], r["pattern"]) for r in judge(captures, events).select("id", "verdict", "pattern").collect()}
    assert got == {0: ("allow", "bad.com/" + "q/" * 5), 1: ("block", "c.d"), 2: ("block", "c.d"), 3: ("none", None), 4: ("block", "bad.com")}


def test_empty_list_and_table(spark):
    events = spark.createDataFrame([], "pattern string, verdict string, dated timestamp")
    captures = spark.createDataFrame([("http://a.b/c", DAY(1))], "url string, fetched_at timestamp")
    assert judge(captures, events).first()["verdict"] == "none"
    assert judge(captures.limit(0), events).count() == 0
