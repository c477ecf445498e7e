"""Reads of one thing by another: incidents, groups, anchors, board rows, signers, breakers, bundles of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import is_open


def incident_of_key(links: DataFrame, incidents: DataFrame, key: str = "sig") -> DataFrame:
    """key, inc: the open incident that was linked last, else the last one that was linked at all. links are (key, inc, seq)."""
    last = links.groupBy(key, "inc").agg(F.max("seq").alias("seq")).join(incidents.select("inc", "state"), "inc")
    return last.groupBy(key).agg(F.coalesce(F.max_by("inc", F.when(is_open(F.col("state")), F.col("seq"))), F.max_by("inc", "seq")).alias("inc"))


def open_by_key(links: DataFrame, incidents: DataFrame, key: str) -> DataFrame:
    """key, inc: the open incident that was linked last; keys without one have no row."""
    last = links.groupBy(key, "inc").agg(F.max("seq").alias("seq"))
    return last.join(incidents.where(is_open(F.col("state"))).select("inc"), "inc").groupBy(key).agg(F.max_by("inc", "seq").alias("inc"))


def open_for_pair(pairs: DataFrame, by_first: DataFrame, by_second: DataFrame, first: str, second: str) -> DataFrame:
    """pairs with the incident open for the first key, else for the second."""
    joined = pairs.join(by_first.withColumnRenamed("inc", "_a"), first, "left").join(by_second.withColumnRenamed("inc", "_b"), second, "left")
    return joined.withColumn("inc", F.coalesce("_a", "_b")).drop("_a", "_b")


def resolved_within(records: DataFrame, as_of: Column, seconds: int, key: str = "sig") -> DataFrame:
    """key, inc: the incident resolved last, if that is no longer ago than the reopen window."""
    done = records.where("state = 'resolved'").groupBy(key).agg(F.max_by(F.struct("inc", "ts"), "seq").alias("r"))
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return done.where(us(as_of) - us(F.col("r.ts")) <= seconds * 1_000_000).select(key, F.col("r.inc").alias("inc"))


def with_all_gaps(incidents: DataFrame, records: DataFrame) -> DataFrame:
    """Incidents, each with how many gaps the log has and the first and last of them: a one-row table meets every incident."""
    gaps = records.where("kind = 'gap'").agg(F.count("*").alias("gaps"), F.min("seq").alias("first_gap"), F.max("seq").alias("last_gap"))
    return incidents.crossJoin(F.broadcast(gaps))


def rule_rows(rules: DataFrame, stats: DataFrame, breakers: DataFrame) -> DataFrame:
    """Rules with their statistics and the state of their breaker, where they have any."""
    return rules.join(stats, "rule", "left").join(breakers, "rule", "left").withColumn("fires", F.coalesce("fires", F.lit(0).cast("long"))).withColumn("breaker", F.coalesce("breaker", F.lit("closed")))


def bundle(groups: DataFrame, incidents: DataFrame, running: DataFrame) -> DataFrame:
    """Per group its incident and the release that runs: `bundle` is null where both releases are known and differ."""
    joined = groups.join(incidents, "sig", "left").join(running, "source", "left")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    differ = F.coalesce(some("release") != some("running"), F.lit(False))
    return joined.withColumn("bundle", F.when(~differ, F.struct("inc", "n", F.coalesce(some("running"), some("release")).alias("release"))))


def release_order(release: Column) -> Column:
    """What releases of numbers sort by: array<long> of their segments; a word counts as nothing."""
    return F.transform(F.split(release, r"[.\-]", -1), lambda s: F.coalesce(F.regexp_replace(s, "^[vV]", "").try_cast("long"), F.lit(-1).cast("long")))


def previous_release(releases: DataFrame, project: str) -> DataFrame:
    """releases (project, release) with the newest one that orders before each."""
    order = Window.partitionBy(project).orderBy(release_order(F.col("release")), "release")
    return releases.select(project, "release").distinct().withColumn("previous", F.lag("release").over(order))


def anchors(issues: DataFrame) -> DataFrame:
    """driver, sig, project, issue: the newest issue of each."""
    return issues.groupBy("driver", "sig", "project").agg(F.max_by("issue", "seq").alias("issue"))


def held_by(arrivals: DataFrame, scopes: Column, breakers: DataFrame) -> DataFrame:
    """arrivals with the first of their scopes whose breaker (scope, state) is open or half-open; breakers are few by configuration."""
    states = F.broadcast(breakers.where(F.col("state").isin("open", "half_open")).groupBy().agg(F.map_from_entries(F.collect_list(F.struct("scope", "state"))).alias("_b")))
    held = F.get(F.filter(scopes, lambda s: F.map_contains_key("_b", s)), F.lit(0))
    return arrivals.crossJoin(states).withColumn("held_by", held).drop("_b")


def signers_of(requests: DataFrame, signers: DataFrame, trust: tuple[str, ...] = ("root", "delegate")) -> DataFrame:
    """requests (key_id) with their signer (key_id, name, enabled, trust), or the error: unknown, disabled or of an unknown trust."""
    joined = requests.join(signers, "key_id", "left")
    error = F.when(F.col("name").isNull(), "unknown_signer").when(~F.col("enabled"), "disabled_signer").when(~F.coalesce(F.col("trust").isin(*trust), F.lit(False)), "unknown_trust")
    return joined.withColumn("error", error)


def new_rows(rows: DataFrame, board: DataFrame, key: str = "sig") -> DataFrame:
    """Rows whose key the board doesn't hold yet."""
    return rows.join(board.select(key).distinct(), key, "left_anti")


def has_event(wanted: DataFrame, events: DataFrame) -> DataFrame:
    """wanted (task, type, dedup) with `known`: such an event exists; an empty dedup key matches any."""
    e = events.select("task", "type", F.col("dedup").alias("_k")).distinct()
    w = wanted.withColumn("_w", F.monotonically_increasing_id())
    hit = w.join(e, ["task", "type"]).where((F.col("dedup") == "") | (F.col("dedup") == F.col("_k"))).select("_w").distinct().withColumn("_hit", F.lit(True))
    return w.join(hit, "_w", "left").withColumn("known", F.coalesce("_hit", F.lit(False))).drop("_w", "_hit")
