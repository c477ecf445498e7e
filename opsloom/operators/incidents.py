"""Incidents: folds of their records, views, timelines, pages, related rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import is_open


def fold(records: DataFrame, fields: list[str], key: str = "inc", refused: Column | None = None) -> DataFrame:
    """Per incident the last non-empty value of each field, by seq; refused transitions are ignored."""
    live = records if refused is None else records.where(~F.coalesce(refused, F.lit(False)))
    last = [F.max_by(F.col(f), F.when(F.nullif(F.col(f).cast("string"), F.lit("")).isNotNull(), F.col("seq"))).alias(f) for f in fields]
    return live.groupBy(key).agg(*last, F.max("ts").alias("updated_ts"), F.max("seq").alias("last_seq"))


def open_incidents(incidents: DataFrame, limit: int) -> DataFrame:
    """Open ones, the last updated first."""
    return incidents.where(is_open(F.col("state"))).orderBy(F.col("updated_ts").desc(), "inc").limit(limit)


def timeline(records: DataFrame, limit: int, key: str = "inc") -> DataFrame:
    """The newest records of each incident, the oldest of them first."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("seq").desc()))
    return records.withColumn("_n", place).where(F.col("_n") <= limit).drop("_n").orderBy(key, "seq")


def evidence(incidents: DataFrame, records: DataFrame, most: int = 512) -> DataFrame:
    """Per incident: how many records it has, how many are kept, how many overflow, and the kept seqs."""
    place = F.row_number().over(Window.partitionBy("inc").orderBy(F.col("seq").desc()))
    mine = incidents.select("inc").join(records.select("inc", "seq"), "inc").withColumn("_n", place)
    return mine.groupBy("inc").agg(F.count("*").alias("n"), F.count_if(F.col("_n") <= most).alias("kept"), F.count_if(F.col("_n") > most).alias("overflow"), F.sort_array(F.collect_list(F.when(F.col("_n") <= most, F.col("seq")))).alias("seqs"))


def page(records: DataFrame, size: int, before: int | None = None, kind: str | None = None) -> DataFrame:
    """A page, newest first, and on every row the token of the next one: null exactly at the end."""
    some = records.where(F.col("kind") == kind) if kind else records
    if before is not None:
        some = some.where(F.col("seq") < before)
    rows = some.orderBy(F.col("seq").desc()).limit(size + 1).withColumn("_n", F.row_number().over(Window.orderBy(F.col("seq").desc())))
    more = F.max("_n").over(Window.partitionBy()) > size
    last = F.min(F.when(F.col("_n") <= size, F.col("seq"))).over(Window.partitionBy())
    return rows.withColumn("next", F.when(more, last)).where(F.col("_n") <= size).drop("_n")


def page_size(asked: int, default: int = 500, most: int = 5000) -> int:
    return default if asked <= 0 else min(asked, most)


def clamped_size(asked: Column, default: int = 500, most: int = 5000) -> Column:
    return F.when(asked <= 0, default).otherwise(F.least(asked, F.lit(most)))


def titles(incidents: DataFrame, groups: DataFrame) -> DataFrame:
    """An incident's title: the group's title, else its digest, else the signature, else the id."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    joined = incidents.join(groups.select("sig", F.col("title").alias("g_title"), F.col("digest").alias("g_digest")), "sig", "left")
    return joined.select("inc", F.coalesce(some("g_title"), some("g_digest"), some("sig"), F.col("inc")).alias("title"))


def latest_before(left: DataFrame, right: DataFrame, key: str, value: str, ts: str = "ts", within: str | None = None) -> DataFrame:
    """As-of join: left with the value of the latest right row at or before it. One sort of both sides together, no pairs."""
    a = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast("timestamp").alias("_vt"), F.lit(1).alias("_side"))
    b = right.select(key, ts, F.col(value).alias("_v"), F.col(ts).alias("_vt"), F.lit(0).alias("_side"))
    order = Window.partitionBy(key).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    out = both.withColumn("_lv", F.last(F.when(F.col("_side") == 0, F.struct("_v", "_vt")), ignorenulls=True).over(order)).where("_side = 1")
    found = F.col("_lv._v") if within is None else F.when(F.col("_lv._vt") >= F.col(ts) - F.expr(f"interval {within}"), F.col("_lv._v"))
    return out.withColumn(value, found).drop("_v", "_vt", "_side", "_lv")


def resolve_versions(wanted: DataFrame, skills: DataFrame) -> DataFrame:
    """The skill of the highest version that lists the signature; `tied` if several have it."""
    each = skills.select("name", "version", F.explode("sigs").alias("sig"))
    joined = wanted.join(each, "sig")
    ranked = joined.withColumn("r", F.rank().over(Window.partitionBy("sig").orderBy(F.col("version").desc()))).where("r = 1")
    return ranked.groupBy("sig").agg(F.min("name").alias("name"), F.max("version").alias("version"), (F.count("*") > 1).alias("tied"))


def classify_by_table(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Slug of (source, subject), else of (source, *), else of (taxonomy, *)."""
    exact = table.where(F.col("subject") != "*").select("source", "subject", F.col("slug").alias("s1"))
    wild = table.where(F.col("subject") == "*").select("source", F.col("slug").alias("s2"))
    tax = table.where(F.col("subject") == "*").select(F.col("source").alias("taxonomy"), F.col("slug").alias("s3"))
    return rows.join(exact, ["source", "subject"], "left").join(wild, "source", "left").join(tax, "taxonomy", "left").withColumn("slug", F.coalesce("s1", "s2", "s3")).drop("s1", "s2", "s3")


def droppable(generations: DataFrame, markers: DataFrame, keep: int) -> DataFrame:
    """Generations beyond the newest `keep` with their last marker's state: verified ones may go, others block."""
    state = markers.groupBy("file").agg(F.max_by("state", "line").alias("state"))
    old = generations.withColumn("_n", F.row_number().over(Window.orderBy(F.col("first_seq").desc()))).where(F.col("_n") > keep).drop("_n")
    return old.join(state, "file", "left").withColumn("drop", F.coalesce(F.col("state") == "verified", F.lit(False)))


def evicted(entries: DataFrame, budget: int, floor: int, most_attempts: int, expired: Column) -> DataFrame:
    """Why an entry leaves a spool: attempts, then age, then the byte budget counted from the newest; `floor` newest always stay."""
    newest = Window.partitionBy("driver").orderBy(F.col("ts").desc(), F.col("id").desc())
    gone = F.when(F.col("attempts") >= most_attempts, "attempts").when(expired, "ttl")
    left = entries.withColumn("reason", gone)
    kept_bytes = F.sum(F.when(F.col("reason").isNull(), F.col("bytes")).otherwise(0)).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    place = F.row_number().over(newest)
    return left.withColumn("reason", F.coalesce("reason", F.when((kept_bytes > budget) & (place > floor), "budget"))).where("reason is not null")


def valid_rows(rows: DataFrame) -> DataFrame:
    """Board rows with the array of what is wrong with them."""
    bad = lambda test, name: F.when(~F.coalesce(test, F.lit(False)), F.lit(name))
    checks = [
        bad(F.col("id").rlike(r"^tsk_[0-9A-Za-z]+\z"), "id"), bad(F.length("title").between(1, 200), "title"), bad(F.col("status").isin("todo", "doing", "done", "blocked"), "status"),
        bad(F.col("priority").isin("P0", "P1", "P2", "P3"), "priority"), bad(F.col("complexity").isin("S", "M", "L"), "complexity"), bad(F.col("sig") != "", "sig"), bad(F.col("inc") != "", "inc"),
    ]
    return rows.withColumn("problems", F.array_compact(F.array(*checks)))


def is_compaction(payload: Column, broad: bool = False) -> Column:
    """Whether a payload marks a compaction's aggregate; the broad test also takes any that says it is one."""
    marker = F.coalesce(F.get_json_object(payload, "$.op") == "compaction_aggregate", F.lit(False))
    return marker | F.coalesce(F.get_json_object(payload, "$.aggregate") == "true", F.lit(False)) if broad else marker


def filtered(rows: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows of a process or connection table: a text is a pattern of like, two numbers a range, several texts a choice; None is no filter."""
    for name, value in wanted.items():
        if isinstance(value, str):
            rows = rows.where(F.col(name).like(value))
        elif isinstance(value, tuple) and value and isinstance(value[0], (int, float)):
            rows = rows.where(F.col(name).between(*value))
        elif value is not None:
            rows = rows.where(F.col(name).isin(*value))
    return rows


def is_protected(path: Column, prefixes: tuple[str, ...]) -> Column:
    """Whether a path is one of the protected ones or lies below one."""
    out = F.lit(False)
    for p in prefixes:
        out |= (path == p) | F.startswith(path, F.lit(p.rstrip("/") + "/"))
    return out


def view(incidents: DataFrame, as_of: Column) -> DataFrame:
    """What a list of incidents shows: state, severity, whole minutes since the last change, whether it is open."""
    age = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("updated_ts").cast("timestamp"))) / 60_000_000)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return incidents.select("inc", text("state").alias("state"), text("severity").alias("severity"), age.alias("age_minutes"), is_open(F.col("state")).alias("open"))
