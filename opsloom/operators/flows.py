"""Flows that need no state machine: boot holds, wait times, carry-over, probes, drafts, parks, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _us(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def boot_holds(arrivals: DataFrame, seconds: int, manager: str = "source") -> DataFrame:
    """arrivals with `held`: within the time after the first one of their manager, which marks its boot."""
    boot = arrivals.groupBy(manager).agg(F.min("ts").alias("_boot"))
    return arrivals.join(F.broadcast(boot), manager).withColumn("held", _us(F.col("ts")) - _us(F.col("_boot")) < seconds * 1_000_000).drop("_boot")


def drained(held: DataFrame, batch: int, manager: str = "source") -> DataFrame:
    """held with the number of the batch in which they leave, the oldest first."""
    place = F.row_number().over(Window.partitionBy(manager).orderBy("ts", "seq"))
    return held.withColumn("batch", F.floor((place - 1) / batch).cast("long"))


def recovered(held: DataFrame, failed: DataFrame, key: str = "scope") -> DataFrame:
    """Held units that aren't failed any more: they get no incident."""
    return held.select(key).distinct().join(failed.select(key).distinct(), key, "left_anti")


def carried_over(timers: DataFrame, rules: DataFrame) -> DataFrame:
    """Timers (rule, fingerprint, sig) that a reload keeps: those of rules that mean what they meant."""
    return timers.join(rules.select("rule", "fingerprint"), ["rule", "fingerprint"], "left_semi")


def open_times(trips: DataFrame, base: int, longest: int, scope: str = "scope") -> DataFrame:
    """Openings (move is trip) with how long they last: doubled with each one since the last closing (move is close), up to the longest."""
    order = Window.partitionBy(scope).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum((F.col("move") == "close").cast("int")).over(order)
    numbered = trips.withColumn("_run", run).where("move = 'trip'")
    nth = F.row_number().over(Window.partitionBy(scope, "_run").orderBy("seq"))
    return numbered.withColumn("seconds", F.least(F.lit(float(base)) * F.pow(F.lit(2.0), nth - 1), F.lit(float(longest)))).drop("_run")


def closed_by_proof(half_open: DataFrame, verdicts: DataFrame, scope: str = "scope") -> DataFrame:
    """Half-open scopes (scope, since) and the first passing verdict (scope, ts, passed) since then, null if there is none."""
    proof = half_open.join(verdicts.where("passed"), scope, "left").where(F.col("ts").isNull() | (F.col("ts") >= F.col("since")))
    first = proof.groupBy(scope).agg(F.min("ts").alias("closed"))
    return half_open.join(first, scope, "left").select(scope, "since", "closed")


def canary_misses(canaries: DataFrame, expected: DataFrame, as_of: Column, interval_seconds: int, key: str = "scope") -> DataFrame:
    """expected with `missed`: no canary, or the newest one is older than twice the interval."""
    newest = canaries.groupBy(key).agg(F.max("ts").alias("_t"))
    late = F.coalesce(_us(as_of) - _us(F.col("_t")) > 2 * interval_seconds * 1_000_000, F.lit(True))
    return expected.join(newest, key, "left").withColumn("missed", late).drop("_t")


def recent_most(rows: DataFrame, as_of: Column, seconds: int, most: int, key: str) -> DataFrame:
    """Entries seen within the time, the last seen of them up to a number."""
    return rows.where(_us(as_of) - _us(F.col("ts")) <= seconds * 1_000_000).orderBy(F.col("ts").desc(), key).limit(most)


#: Rungs in order, and the states in which the driver acts.
RUNGS, ACTS_ON = ("play", "research", "agent"), ("recorded", "play:drafted")


def rungs_to_try(incidents: DataFrame) -> DataFrame:
    """incidents (state, ceiling) with the rungs that the driver tries, in order up to the ceiling; none in states it leaves alone."""
    ranks = F.array(*(F.struct(F.lit(i + 1).alias("i"), F.lit(r).alias("r")) for i, r in enumerate(RUNGS)))
    ceiling = F.coalesce(F.array_position(F.array(*map(F.lit, RUNGS)), F.col("ceiling")), F.lit(0))
    tried = F.transform(F.filter(ranks, lambda x: x["i"] <= ceiling), lambda x: x["r"])
    return incidents.withColumn("rungs", F.when(F.col("state").isin(*ACTS_ON), tried).otherwise(F.array().cast("array<string>")))


def suppressions(transitions: DataFrame, terminal: tuple[str, ...] = ("resolved", "escalated", "quarantined")) -> DataFrame:
    """The moves that end an incident: each opens a suppression from its seq on until the incident's next move, if there is one."""
    after = F.lead("seq").over(Window.partitionBy("inc").orderBy("seq"))
    return transitions.where("not refused").withColumn("until_seq", after).where(F.col("to_state").isin(*terminal)).select("inc", F.col("seq").alias("from_seq"), "until_seq")


def parked(rows: DataFrame, as_of: Column, key: str = "scope") -> DataFrame:
    """The newest park row of each key, if it hasn't expired: taken up again the oldest first; plays only check."""
    last = rows.groupBy(key).agg(F.max_by(F.struct("seq", "kind", "until"), "seq").alias("p")).select(key, "p.*")
    return last.where(F.col("until") > as_of).withColumn("mode", F.when(F.col("kind") == "play", "check_only").otherwise("resume"))


def known_keys(claims: DataFrame, restored: DataFrame, until: Column, key: str = "key") -> DataFrame:
    """claims with `duplicate`: their key was restored at the start and the grace window isn't over."""
    r = restored.select(key).distinct().withColumn("_r", F.lit(True))
    return claims.join(r, key, "left").withColumn("duplicate", F.coalesce(F.col("_r"), F.lit(False)) & (F.col("ts") < until)).drop("_r")


def unexpired(canaries: DataFrame, as_of: Column, seconds: int) -> DataFrame:
    """canaries with `expired`: older than their validity."""
    return canaries.withColumn("expired", _us(as_of) - _us(F.col("ts")) > seconds * 1_000_000)


def landed(rows: DataFrame, commits: DataFrame, branches: tuple[str, ...]) -> DataFrame:
    """Completed rows whose commit exists on an allowed branch."""
    return rows.where("status = 'done'").join(commits.where(F.col("branch").isin(*branches)).select("commit").distinct(), "commit", "left_semi")


def merged_table(built_in: DataFrame, user: DataFrame, key: list[str], value: str) -> DataFrame:
    """A built-in table with a user's rows over it: theirs win, and theirs alone are added."""
    mine = user.select(*key, F.col(value).alias("_v"))
    return built_in.join(mine, key, "full_outer").withColumn(value, F.coalesce("_v", value)).drop("_v")


def resolved_tokens(tokens: DataFrame, files: DataFrame, oldest_day: str) -> DataFrame:
    """Where a page token (generation, offset, seq) resumes: `end` within the file, or why the walk starts over: token_invalid, token_foreign
    (of a day before any that is known) or generation_dropped."""
    joined = tokens.join(F.broadcast(files.select(F.col("file").alias("generation"), "size")), "generation", "left")
    day = F.regexp_extract("generation", r"^(\d{4}-\d{2}-\d{2})\.g\d+\.p\d+\.jsonl\z", 1)
    reason = F.when(F.col("size").isNotNull(), None).when(day == "", "token_invalid").when(day < oldest_day, "token_foreign").otherwise("generation_dropped")
    end = F.when(F.col("offset").between(1, F.col("size")), F.col("offset")).otherwise(F.col("size"))
    return joined.withColumn("reset", reason).withColumn("end", end)
