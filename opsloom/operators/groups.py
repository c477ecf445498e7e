"""Groups of one signature: statistics, snapshots, ranking, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import running_sum


def group_stats(records: DataFrame, key: str = "sig") -> DataFrame:
    """Per group: count, first and last time and seq, last source, release range."""
    return records.groupBy(key).agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("seq").alias("last_seq"),
        F.max_by("source", "seq").alias("last_source"), F.min_by("release", "seq").alias("first_release"), F.max_by("release", "seq").alias("last_release"),
    )


def top_groups(stats: DataFrame, n: int, by: str = "n", key: str = "sig", since: Column | None = None) -> DataFrame:
    """The n largest groups, ties by key; groups last seen before `since` are stale."""
    live = stats if since is None else stats.where(F.col("last_ts") >= since)
    return live.orderBy(F.col(by).desc(), F.col(key)).limit(n)


def with_snapshots(events: DataFrame, snapshots: DataFrame, key: str = "sig") -> DataFrame:
    """The last snapshot of a group (seq, n, upper_seq) and the events after it: key, n, last_seq."""
    last = snapshots.groupBy(key).agg(F.max_by(F.struct("n", "upper_seq"), "seq").alias("s")).select(key, F.col("s.n").alias("base"), F.col("s.upper_seq").alias("upper"))
    joined = events.join(last, key, "left").where(F.col("upper").isNull() | (F.col("seq") > F.col("upper")))
    more = joined.groupBy(key).agg(F.count("*").alias("more"), F.max("seq").alias("top"))
    both = last.join(more, key, "full_outer")
    return both.select(key, (F.coalesce("base", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("upper", "top").alias("last_seq"))


def release_span(records: DataFrame, key: str = "sig") -> DataFrame:
    """First and last non-empty release of each group."""
    some = F.nullif("release", F.lit(""))
    have = records.where(some.isNotNull())
    return have.groupBy(key).agg(F.min_by("release", "seq").alias("first_release"), F.max_by("release", "seq").alias("last_release"))


def source_liveness(records: DataFrame, as_of: Column, within: str = "24 hours") -> DataFrame:
    """Per source: last time and seq, totals, and counts by kind of the last day."""
    recent = F.col("ts") > as_of - F.expr(f"interval {within}")
    count = lambda k: F.count_if(recent & (F.col("kind") == k))
    return records.groupBy("source").agg(
        F.max("ts").alias("last_ts"), F.max("seq").alias("last_seq"), F.count("*").alias("n"), count("event").alias("events_24h"), count("gap").alias("gaps_24h"), count("canary").alias("canaries_24h"), F.max(F.when(F.col("kind") == "canary", F.col("ts"))).alias("canary_ts")
    )


def lookup(records: DataFrame, key: str, value: Column, by: str = "seq") -> DataFrame:
    """key to value, the last writer wins."""
    return records.groupBy(key).agg(F.max_by(value, by).alias("value"))


def kind_counts(records: DataFrame, by: str) -> DataFrame:
    """Counts of each kind as a map, one row a group."""
    each = records.groupBy(by, "kind").agg(F.count("*").alias("c"))
    return each.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "c")))).alias("kinds"))


def due_flushes(records: DataFrame, every: int = 100, key: str = "sig") -> DataFrame:
    """Records with which a group reaches another multiple of `every`, with their place in it (nth)."""
    return running_sum(records, F.lit(1), key, "nth").where(F.col("nth") % every == 0)


def to_replay(events: DataFrame, snapshots: DataFrame, key: str = "sig") -> DataFrame:
    """Events after the last snapshot of their group."""
    last = snapshots.groupBy(key).agg(F.max_by("upper_seq", "seq").alias("upper"))
    return events.join(last, key, "left").where(F.col("upper").isNull() | (F.col("seq") > F.col("upper"))).drop("upper")
