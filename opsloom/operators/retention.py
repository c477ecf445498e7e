"""What is kept and for how long: days, spools, groups, caps, counters, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _us(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def day_totals(records: DataFrame, size: Column) -> DataFrame:
    """day, rows, bytes, first_seq, last_seq, min_ts, max_ts."""
    return records.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("rows"), F.sum(size).alias("bytes"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts")
    )


def eligible_days(days: DataFrame, as_of: Column, min_age_days: int, min_bytes: int) -> DataFrame:
    """Days to compact: old enough and large enough."""
    return days.where((F.datediff(as_of, F.to_date("day")) >= min_age_days) & (F.col("bytes") >= min_bytes))


def expired_days(days: DataFrame, as_of: Column, keep_days: int) -> DataFrame:
    """Days beyond retention; whole partitions of them go."""
    return days.where(F.datediff(as_of, F.to_date("day")) > keep_days)


def backpressure(gaps: DataFrame, cause: Column) -> DataFrame:
    """scope, folds, lost: gaps of the cause by scope and the records that they stand for."""
    return gaps.groupBy("scope").agg(F.count_if(cause).alias("folds"), F.sum(F.when(cause, F.col("k")).otherwise(0)).cast("long").alias("lost"))


def disposition_counts(records: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Counts of each disposition, a column each."""
    return records.groupBy(*by).agg(*(F.count_if(F.col("disposition") == n).alias(n) for n in names))


def trailing_counts(records: DataFrame, as_of: Column, spans: dict[str, int], by: list[str]) -> DataFrame:
    """Rows of the trailing seconds before as_of (that moment included), a column for each span; groups without any are left out."""
    age = _us(as_of) - _us(F.col("ts"))
    inside = records.withColumn("_age", age).where((F.col("_age") >= 0) & (F.col("_age") < max(spans.values()) * 1_000_000))
    return inside.groupBy(*by).agg(*(F.count_if(F.col("_age") < s * 1_000_000).alias(n) for n, s in spans.items()))


def budget_state(used: DataFrame, limits: DataFrame) -> DataFrame:
    """class, most, used, left, exhausted: what is left of each budget."""
    joined = limits.join(used, "class", "left").withColumn("used", F.coalesce("used", F.lit(0).cast("long")))
    return joined.withColumn("left", F.greatest(F.col("most") - F.col("used"), F.lit(0).cast("long"))).withColumn("exhausted", F.col("used") >= F.col("most"))


def over_budget(entries: DataFrame, budget: int, by: str) -> DataFrame:
    """Entries beyond the byte budget of their spool, counted from the newest; what a spool drops is its oldest."""
    newest = Window.partitionBy(by).orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("_sum", F.sum("bytes").over(newest)).where(F.col("_sum") > budget).drop("_sum")


def gap_rows(dropped: DataFrame, by: str) -> DataFrame:
    """A gap for each spool that dropped something: how many, how many bytes, from where to where."""
    return dropped.groupBy(by).agg(F.count("*").alias("dropped"), F.sum("bytes").alias("bytes"), F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq"))


def over_count(entries: DataFrame, most: int, by: str) -> DataFrame:
    """Entries beyond the newest `most` of their spool."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col("seq").desc()))
    return entries.withColumn("_n", place).where(F.col("_n") > most).drop("_n")


def evicted_lru(rows: DataFrame, most: int, pinned: Column, key: str, seen: str = "last_seq") -> DataFrame:
    """Rows that leave when only the `most` last seen of those that aren't pinned may stay: what top-n keeps is taken away from all."""
    loose = rows.where(~F.coalesce(pinned, F.lit(False)))
    kept = loose.orderBy(F.col(seen).desc(), F.col(key)).limit(most).select(key)
    return loose.join(kept, key, "left_anti")


def due_batch(entries: DataFrame, as_of: Column, budget: int) -> DataFrame:
    """Entries whose next try is due, the oldest first, as many as the budget allows."""
    return entries.where(F.col("next_try_ts") <= as_of).orderBy("next_try_ts", "seq").limit(budget)


def backoff_seconds(attempt: Column, base: float, longest: float) -> Column:
    """The wait before a retry: doubled with every attempt up to the longest."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0))), F.lit(float(longest)))


def admitted_replay(entries: DataFrame, quota: DataFrame, by: str = "project") -> DataFrame:
    """entries with `outcome` of a replay, oldest first: unknown projects and unreadable entries go, what the quota (project, room) leaves is admitted, the rest waits."""
    known = entries.join(quota, by, "left")
    usable = F.col("room").isNotNull() & F.col("readable")
    place = F.sum(F.when(usable, 1).otherwise(0)).over(Window.partitionBy(by).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    outcome = F.when(F.col("room").isNull(), "unknown_project").when(~F.col("readable"), "unreadable").when(F.col("_n") <= F.col("room"), "admitted").otherwise("waits")
    return known.withColumn("_n", place).withColumn("outcome", outcome).drop("_n", "room")


def stranded(given: DataFrame, acknowledged: DataFrame, as_of: Column, seconds: int) -> DataFrame:
    """Entries that were handed out longer ago than the time and never acknowledged."""
    return given.where(_us(as_of) - _us(F.col("ts")) > seconds * 1_000_000).join(acknowledged.select("seq"), "seq", "left_anti")
