"""Rates, trailing counts, quotas and caps as window frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def minute(ts: Column | str) -> Column:
    return F.floor(F.unix_timestamp(F.col(ts) if isinstance(ts, str) else ts) / 60).cast("long")


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of either kind of timestamp."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def rates(records: DataFrame, key: str = "source") -> DataFrame:
    """Rates of 1, 5 and 60 minutes and the trend, anchored at the group's newest minute.

    The records are counted by minute first, so the frames run over at most one row a minute. The trend compares the
    five minutes before a new minute with the five before those; it changes only when the minute advances and the
    earlier mean isn't 0, and is otherwise carried on."""
    each = records.groupBy(key, minute("ts").alias("m")).agg(F.count("*").alias("c"))
    order = Window.partitionBy(key).orderBy("m")
    over = lambda a, b: F.sum("c").over(order.rangeBetween(a, b)).cast("double")
    step = each.select(key, "m", over(0, 0).alias("s1"), over(-4, 0).alias("s5"), over(-59, 0).alias("s60"), over(-9, -5).alias("p5"))
    moved = F.when(F.col("p5") > 0, (F.col("s5") / 5) / (F.col("p5") / 5) - 1)
    carried = F.coalesce(F.last(moved, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    step = step.withColumn("trend", carried)
    newest = step.groupBy(key).agg(F.max_by(F.struct("m", "s1", "s5", "s60", "trend"), "m").alias("x"))
    return newest.select(key, F.col("x.m").alias("last_minute"), F.col("x.s1").alias("rate_1m"), (F.col("x.s5") / 5).alias("rate_5m"), (F.col("x.s60") / 60).alias("rate_60m"), F.col("x.trend").alias("trend"))


def hourly_total(records: DataFrame, as_of: Column, key: str = "source", hours: int = 24) -> DataFrame:
    """Records of the last calendar hours, the running one included."""
    hour = lambda c: F.floor(F.unix_timestamp(c) / 3600)
    return records.groupBy(key).agg(F.count_if((hour(F.col("ts")) > hour(as_of) - hours) & (hour(F.col("ts")) <= hour(as_of))).alias("n"))


def trailing(records: DataFrame, seconds: int, key: str = "scope", ts: str = "ts") -> DataFrame:
    """records with `recent`: how many of the group stand in the last seconds, this one included."""
    frame = Window.partitionBy(key).orderBy(micros(ts)).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return records.withColumn("recent", F.count("*").over(frame))


def flaps(records: DataFrame, seconds: int = 3600, most: int = 5, key: str = "sig") -> DataFrame:
    """Records with which a group exceeds its cap of a trailing window."""
    return trailing(records, seconds, key).where(F.col("recent") > most)


def quota(records: DataFrame, per_window: int, seconds: int = 60, key: str = "source") -> DataFrame:
    """records with window number, place in it and whether they are admitted; only the first ones are."""
    w = F.floor(F.unix_timestamp("ts") / seconds).cast("long")
    place = F.row_number().over(Window.partitionBy(key, "w").orderBy("seq"))
    return records.withColumn("w", w).withColumn("place", place).withColumn("admitted", F.col("place") <= per_window)


def quota_view(records: DataFrame, per_window: int, seconds: int = 60, key: str = "source") -> DataFrame:
    """Used and refused of each window, and the used of the window before it that had records."""
    used = quota(records, per_window, seconds, key).groupBy(key, "w").agg(F.count_if("admitted").alias("used"), F.count_if(~F.col("admitted")).alias("refused"))
    return used.withColumn("before", F.lag("used").over(Window.partitionBy(key).orderBy("w")))


def disposition(policy: Column, sample: Column) -> Column:
    """What becomes of a refused record: sampled ones are kept, the others dropped or spooled by policy."""
    return F.when(F.col("admitted"), "accepted").when((policy == "sample") & sample, "sampled").when(policy == "spool", "spooled").otherwise("dropped")


def release_diff(stats: DataFrame, covered: DataFrame, before: str, after: str) -> DataFrame:
    """Per group of (sig, release): new, fixed (only if a canary covers the release), still_open or unproven."""
    seen = stats.groupBy("sig").agg(F.max(F.col("release") == before).alias("old"), F.max(F.col("release") == after).alias("new"))
    cover = covered.where(F.col("release") == after).agg((F.count("*") > 0).alias("covered"))
    status = F.when(F.col("new") & ~F.col("old"), "new").when(F.col("new") & F.col("old"), "still_open").when(F.col("old") & F.col("covered"), "fixed").when(F.col("old"), "unproven")
    return seen.crossJoin(F.broadcast(cover)).withColumn("status", status).where("status is not null").select("sig", "status")


def stalled(records: DataFrame, value: str, most: int, key: str = "source") -> DataFrame:
    """Rows at which a value hasn't moved for at least `most` rows in a row."""
    order = Window.partitionBy(key).orderBy("seq")
    moved = F.coalesce((F.col(value) != F.lag(value).over(order)).cast("int"), F.lit(1))
    runs = records.withColumn("run", F.sum(moved).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    held = runs.withColumn("held", F.row_number().over(Window.partitionBy(key, "run").orderBy("seq")) - 1)
    return held.where(F.col("held") >= most)


def episodes(records: DataFrame, gap_seconds: int, key: str = "scope") -> DataFrame:
    """Runs of records no further apart than the gap: key, episode, n, first and last time."""
    order = Window.partitionBy(key).orderBy("ts", "seq")
    opens = F.coalesce((micros("ts") - F.lag(micros("ts")).over(order) > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    numbered = records.withColumn("episode", F.sum(opens).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "episode").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def held_for(records: DataFrame, condition: Column, seconds: int, key: str = "scope") -> DataFrame:
    """Rows at which the condition has held without a break for the given time: a false row starts over."""
    order = Window.partitionBy(key).orderBy("seq")
    met = F.coalesce(condition, F.lit(False))
    broken = records.withColumn("met", met).withColumn("run", F.sum((~met).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    since = F.min(F.when(F.col("met"), micros("ts"))).over(Window.partitionBy(key, "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return broken.where("met").withColumn("held_us", micros("ts") - since).where(F.col("held_us") >= seconds * 1_000_000)


def capped(records: DataFrame, most: int, key: list[str]) -> DataFrame:
    """The first records of each key, at most so many."""
    return records.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("seq"))).where(F.col("nth") <= most)


def running_sum(records: DataFrame, value: Column, by: str, name: str, chunk: int = 65_536) -> DataFrame:
    """records with a running sum by seq. A key of any size is spread: seqs are cut into chunks, each sums for itself, and what stands
    before a chunk comes from a table of one row a chunk."""
    cut = records.withColumn("_chunk", F.floor(F.col("seq") / chunk)).withColumn("_value", value)
    totals = cut.groupBy(by, "_chunk").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(by, "_chunk", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    own = F.sum("_value").over(Window.partitionBy(by, "_chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return cut.join(before, [by, "_chunk"]).withColumn(name, F.col("_before") + own).drop("_chunk", "_value", "_before")


def batches(records: DataFrame, size: str, most: int, key: str = "source") -> DataFrame:
    """Batch numbers by a running sum of sizes, in order."""
    summed = running_sum(records, F.col(size), key, "_sum")
    return summed.withColumn("batch", F.floor((F.col("_sum") - F.col(size)) / most).cast("long")).drop("_sum")


def next_arrival(points: DataFrame, records: DataFrame, at: str, name: str) -> DataFrame:
    """points with the time of the first record at or after a moment, whatever its key; null if none comes any more.

    Both sides meet by day and are sorted within it; a moment after the last record of its day gets the first one of the next day that has any."""
    day = lambda c: F.to_date(F.col(c)).alias("_day")
    days = records.groupBy(day("ts")).agg(F.min("ts").alias("_first"))
    following = days.select("_day", "_first").withColumn("_side", F.lit(0))
    asked = points.select(F.to_date(F.col(at)).alias("_day")).distinct().withColumn("_side", F.lit(1))
    order = Window.orderBy(F.desc("_day"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, -1)  # a row a day
    later = asked.unionByName(following, allowMissingColumns=True).withColumn("_later", F.last("_first", ignorenulls=True).over(order)).where("_side = 1").select("_day", "_later")
    p = points.withColumn("_day", F.to_date(F.col(at))).withColumn("_t", F.col(at)).withColumn("_side", F.lit(1))
    r = records.select(day("ts"), F.col("ts").alias("_t"), F.lit(0).alias("_side")).distinct()
    within = Window.partitionBy("_day").orderBy(F.desc("_t"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(r, allowMissingColumns=True).withColumn("_next", F.last(F.when(F.col("_side") == 0, F.col("_t")), ignorenulls=True).over(within)).where("_side = 1")
    return both.join(F.broadcast(later), "_day").withColumn(name, F.coalesce("_next", "_later")).select(*points.columns, name)
