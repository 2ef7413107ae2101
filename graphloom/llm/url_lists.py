"""Temporal URL lists: dated entries become validity intervals, and captures meet those active when fetched.

An event (pattern, verdict, dated) sets the verdict of a host suffix or of a host with a path prefix from its date on
(`block`, `allow`, or `drop`, which takes the entry off the list). An entry is valid from its date to the next date of
the same pattern; of several events of a pattern on one date the last verdict in code-point order counts.

A capture is looked up under the suffixes of its host and the path prefixes of its host that end at a slash, of the
numbers of labels and of slashes that patterns of the list have (so a URL of any length makes few keys); among the entries
active at the time the longest pattern decides (an exact tie cannot be). Captures are counted by
(url, time) first; keys meet the list in an equi-join whose list side holds one row for each pattern, with its intervals in order, so a hot host
is a skewed join side that can be split, never a group in one task.

Defined results: null, empty and unparsable URLs and null times meet no entry (verdict `none`); URLs of any length are
read whole; captures before an
entry's first date don't see it; repeated captures stay as they are; extra columns are kept, and columns named like the
results are replaced; an empty list or table is fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh

RESULTS = ("host", "pattern", "listed_on", "verdict", "blocked")


def host_of(url: Column) -> Column:
    """The lowered host of an absolute URL, without user, port and a final dot; "" if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::[0-9]*)?(?:[/?#]|$)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """The path of an absolute URL without query and fragment."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def shapes(events: DataFrame) -> tuple[list[int], list[int]]:
    """The numbers of labels of the list's host patterns, and of slashes of its path patterns: as many as kinds of patterns."""
    kinds = events.where("pattern is not null").select(
        F.contains("pattern", F.lit("/")).alias("path"), F.when(F.contains("pattern", F.lit("/")), F.regexp_count("pattern", F.lit("/"))).otherwise(F.size(F.split("pattern", r"\."))).alias("n")
    )
    found = kinds.distinct().collect()
    return sorted(r["n"] for r in found if not r["path"]), sorted(r["n"] for r in found if r["path"])


def lookup_keys(host: Column, path: Column, labels: list[int], slashes: list[int]) -> Column:
    """Patterns that a capture can meet: host suffixes of so many labels, and the host with path prefixes of so many slashes."""
    numbers = lambda own: F.array(*[F.lit(n) for n in own]).cast("array<int>")
    parts, steps = F.split(host, r"\."), F.split(path, "/")
    suffixes = F.transform(F.filter(numbers(labels), lambda n: n <= F.size(parts)), lambda n: F.call_function("substring_index", host, F.lit("."), -n))
    prefixes = F.transform(F.filter(numbers(slashes), lambda n: n < F.size(steps)), lambda n: F.concat(host, F.call_function("substring_index", path, F.lit("/"), n), F.lit("/")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(suffixes, prefixes)))


def intervals(events: DataFrame) -> DataFrame:
    """(pattern, verdict, valid_from, valid_to): valid_to is null while the entry holds."""
    dated = events.where(F.col("pattern").isNotNull() & F.col("dated").isNotNull() & F.col("verdict").isNotNull())
    last = dated.groupBy("pattern", "dated").agg(F.max("verdict").alias("verdict"))
    after = F.lead("dated").over(Window.partitionBy("pattern").orderBy("dated"))
    return last.select("pattern", "verdict", F.col("dated").alias("valid_from"), after.alias("valid_to"))


def judge(captures: DataFrame, events: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """captures with host, pattern, listed_on, verdict and blocked added."""
    captures = captures.drop(*RESULTS)
    own_url, own_at = fresh(captures, "own_url", "own_at")
    seen = captures.select(F.col(url).alias("_url"), F.col(at).alias("_at")).distinct().where("_url is not null and _at is not null")
    keyed = seen.withColumn("host", host_of(F.col("_url"))).select("_url", "_at", F.explode(lookup_keys(F.col("host"), path_of(F.col("_url")), *shapes(events))).alias("pattern"))
    entries = F.sort_array(F.collect_list(F.struct("valid_from", "valid_to", "verdict")))
    packed = intervals(events).groupBy("pattern").agg(entries.alias("_entries"))
    met = keyed.join(packed, "pattern")
    active = F.filter("_entries", lambda e: (e["valid_from"] <= F.col("_at")) & (e["valid_to"].isNull() | (F.col("_at") < e["valid_to"])))
    met = met.withColumn("_e", F.get(active, F.lit(0))).where(F.col("_e").isNotNull() & (F.col("_e.verdict") != "drop"))
    # of the patterns that one capture meets, a path prefix is longer than its host and a host longer than its suffixes
    longest = F.max(F.struct(F.length("pattern").alias("_l"), "pattern", F.col("_e.valid_from").alias("listed_on"), F.col("_e.verdict").alias("verdict")))
    found = met.groupBy("_url", "_at").agg(longest.alias("_m"))
    found = found.select(F.col("_url").alias(own_url), F.col("_at").alias(own_at), "_m.pattern", "_m.listed_on", "_m.verdict")
    out = captures.join(found, (F.col(url) == F.col(own_url)) & (F.col(at) == F.col(own_at)), "left")
    return out.select(
        *captures.columns, host_of(F.col(url)).alias("host"), "pattern", "listed_on",
        F.coalesce("verdict", F.lit("none")).alias("verdict"), F.coalesce(F.col("verdict") == "block", F.lit(False)).alias("blocked"),
    )
