"""Queries over the event stream, each with its SQL twin: scans, groups, rates, quotas, evidence, sequence, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, signature
from ..operators import groups, incidents, verify, windows
from ..sources import stream
from . import predicate
from .catalog import query, table

#: The stream view in SQL, as of_events() has it.
R = """r AS (SELECT event_id + 1 AS seq, ts, CASE event_type WHEN 'view' THEN 'canary' WHEN 'signup' THEN 'gap' ELSE 'event' END AS kind, event_type AS source, user_id AS scope,
  'generic:sha256v1:' || substr(sha256('generic' || chr(31) || event_type || chr(31) || user_id || chr(30)), 1, 16) AS sig, value, '1.' || (event_id % 7) AS release,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""
NOW = "timestamp'2024-01-20 00:00:00'"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.of_events(table(spark, sf_dir, "events"))


def now():
    return F.expr(NOW)


# ---------------------------------------------------------------- A scans
@query("a1_full_scan", f"WITH {R} SELECT seq, ts, kind, source, scope, sig, value, release, k FROM r")
def full_scan(spark, d):
    return records(spark, d)


@query("a2_window_scan", f"WITH {R} SELECT seq, ts, kind FROM r WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-07 12:00:00'")
def window_scan(spark, d):
    return records(spark, d).where(F.col("ts").between(F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-07 12:00:00").cast("timestamp"))).select("seq", "ts", "kind")


@query("a3_scan_from_seq", f"WITH {R} SELECT seq, sig FROM r WHERE seq >= 900")
def scan_from(spark, d):
    return records(spark, d).where("seq >= 900").select("seq", "sig")


@query("a5_seq_range", f"WITH {R} SELECT seq, kind FROM r WHERE seq BETWEEN 100 AND 900 ORDER BY seq LIMIT 50")
def seq_range(spark, d):
    return records(spark, d).where("seq between 100 and 900").orderBy("seq").limit(50).select("seq", "kind")


@query("a6_point_lookup", f"WITH {R} SELECT * FROM r WHERE seq = 77")
def point(spark, d):
    return records(spark, d).where("seq = 77")


@query("a21_payload_hash", "SELECT event_id, CASE WHEN octet_length(encode(props)) >= 10 THEN substr(sha256(props), 1, 16) END AS hash FROM events")
def hashes(spark, d):
    return table(spark, d, "events").select("event_id", signature.payload_hash("props", 10).alias("hash"))


@query("a23_day_statistics", f"WITH {R} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq, min(ts) AS min_ts, max(ts) AS max_ts FROM r GROUP BY 1")
def day_statistics(spark, d):
    return records(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts")
    )


@query(
    "a49_latest_marker",
    f"WITH {R}, m AS (SELECT scope AS file, seq AS line, CASE k % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'exported' WHEN 2 THEN 'verified' ELSE 'dropped' END AS state FROM r) SELECT file, arg_max(state, line) AS value FROM m GROUP BY 1",
)
def latest_marker(spark, d):
    state = classify.chosen(F.col("k") % 4, [(0, "pending"), (1, "exported"), (2, "verified")], "dropped")
    return groups.lookup(records(spark, d).select(F.col("scope").alias("file"), F.col("seq").alias("line"), state.alias("state")), "file", F.col("state"), "line")


@query("a50_marker_counts", f"WITH {R} SELECT count(*) AS total, count_if(k % 4 = 0) AS pending, count_if(k % 4 = 1) AS exported, count_if(k % 4 = 2) AS verified, count_if(k % 4 = 3) AS dropped FROM r")
def marker_counts(spark, d):
    return records(spark, d).agg(F.count("*").alias("total"), *(F.count_if(F.col("k") % 4 == i).alias(n) for i, n in enumerate(["pending", "exported", "verified", "dropped"])))


@query("a58_forward_batches", f"WITH {R} SELECT seq, CAST(floor((sum(k) OVER (PARTITION BY source ORDER BY seq) - k) / 500) AS BIGINT) AS batch FROM r")
def forward_batches(spark, d):
    return windows.batches(records(spark, d), "k", 500).select("seq", "batch")


@query("a60_tiered_rows", f"WITH {R} SELECT kind, count(*) AS n FROM r WHERE ts >= TIMESTAMP '2024-01-20' OR kind <> 'event' GROUP BY 1")
def tiered(spark, d):
    return records(spark, d).where((F.col("ts") >= now()) | (F.col("kind") != "event")).groupBy("kind").agg(F.count("*").alias("n"))


@query("a65_oldest_first", f"WITH {R} SELECT seq, sig FROM r WHERE kind = 'gap' ORDER BY seq LIMIT 25")
def drain(spark, d):
    return records(spark, d).where("kind = 'gap'").orderBy("seq").limit(25).select("seq", "sig")


# ---------------------------------------------------------------- B predicates
@query("b1_rule_predicate", f"WITH {R} SELECT seq FROM r WHERE (value > 20 AND source IN ('error', 'click')) OR NOT (k <> 3)")
def rule_predicate(spark, d):
    named = {"value": F.col("value"), "source": F.col("source"), "count": F.col("k").cast("double")}
    return records(spark, d).where(predicate.compile_predicate('(value > 20 and source in ["error", "click"]) or not (count != 3)', None, named)).select("seq")


@query("b9_missing_is_false", f"WITH {R} SELECT count_if(coalesce(x <> 1, false)) AS unequal, count_if(NOT coalesce(x = 1, false)) AS negated FROM (SELECT CASE WHEN k % 2 = 0 THEN k END AS x FROM r)")
def missing_is_false(spark, d):
    named = {"value": F.when(F.col("k") % 2 == 0, F.col("k").cast("double"))}
    of = lambda text: F.count_if(predicate.compile_predicate(text, None, named))
    return records(spark, d).agg(of("value != 1").alias("unequal"), of("not (value == 1)").alias("negated"))


@query("b11_tolerant_equality", f"WITH {R} SELECT seq FROM r WHERE abs(value * 3 / 3 - value) <= 1e-9 * greatest(abs(value * 3 / 3), abs(value))")
def tolerant(spark, d):
    return records(spark, d).where(predicate.numbers_equal(F.col("value") * 3 / 3, F.col("value"))).select("seq")


@query(
    "b13_rule_set",
    f"WITH {R} SELECT seq, array_to_string(list_filter([CASE WHEN source = 'error' AND value >= 30 THEN 'hot' END, CASE WHEN source = 'error' AND regexp_matches(release, '^1[.][0-3]$') THEN 'old' END], lambda x: x IS NOT NULL), ',') AS rules FROM r WHERE source = 'error'",
)
def rule_set(spark, d):
    rules = [
        predicate.Rule("hot", "sentinel", (predicate.Condition("value", ">=", "30", "number"),)),
        predicate.Rule("old", "sentinel", (predicate.Condition("release", "~", "^1[.][0-3]$"),)),
    ]
    named = {"value": F.col("value"), "release": F.col("release")}
    rows = records(spark, d).where("source = 'error'")
    return rows.select("seq", F.array_join(predicate.matched(rules, named, F.lit("sentinel")), ",").alias("rules"))


@query("b20_open_states", "SELECT o_orderkey, s NOT IN ('resolved', 'suppressed', 'quarantined', '') AS ledger_open, s NOT IN ('resolved', 'escalated') AS ladder_open FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'escalated' ELSE 'suppressed' END AS s FROM orders)")
def open_states(spark, d):
    state = classify.chosen(F.col("o_orderstatus"), [("F", "resolved"), ("O", "escalated")], "suppressed")
    return table(spark, d, "orders").select("o_orderkey", classify.is_open(state).alias("ledger_open"), classify.is_open_ladder(state).alias("ladder_open"))


@query("b21_stale_sources", f"WITH {R} SELECT source, epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts)) > 600 * 1000000 AS stale FROM r GROUP BY 1")
def stale_sources(spark, d):
    return records(spark, d).groupBy("source").agg((windows.micros(F.lit("2024-02-01").cast("timestamp")) - windows.micros(F.max("ts")) > 600 * 1_000_000).alias("stale"))


@query("b22_group_key", f"WITH {R} SELECT seq, coalesce(nullif(CASE WHEN k % 3 = 0 THEN sig ELSE '' END, ''), 'mk:' || nullif(CASE WHEN k % 3 = 1 THEN release ELSE '' END, ''), 'sig:' || nullif(sig, '')) AS group_key FROM r")
def group_key(spark, d):
    pick = lambda n, c: F.when(F.col("k") % 3 == n, F.col(c)).otherwise("")
    return records(spark, d).select("seq", signature.group_key(pick(0, "sig"), pick(1, "release"), "sig").alias("group_key"))


@query("b25_foldable", f"WITH {R} SELECT seq FROM r WHERE NOT (k = 1) AND NOT (k = 2) AND (k % 2 = 0 OR k % 5 = 0)")
def foldable(spark, d):
    k = F.col("k")
    return records(spark, d).where(classify.is_foldable(k == 1, k == 2, k % 2 == 0, k % 5 == 0)).select("seq")


@query("b26_failure_paths", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN l_linestatus = 'F' WHEN 'R' THEN l_linestatus = 'O' ELSE l_linestatus = 'F' END AS failed FROM lineitem")
def failure_paths(spark, d):
    path = classify.chosen(F.col("l_returnflag"), [("A", "properties_changed"), ("R", "job_removed")], "reconcile")
    substate = F.when(F.col("l_linestatus") == "F", "failed").otherwise("running")
    result = F.when(F.col("l_linestatus") == "O", "timeout").otherwise("done")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", classify.is_failure(path, substate, result).alias("failed"))


@query(
    "b28_row_validation",
    "SELECT p_partkey, array_to_string(list_filter([CASE WHEN NOT (length(p_name) BETWEEN 1 AND 200) THEN 'title' END, CASE WHEN p_size % 7 = 0 THEN 'priority' END, CASE WHEN p_size % 5 = 0 THEN 'sig' END], lambda x: x IS NOT NULL), ',') AS problems FROM part",
)
def row_validation(spark, d):
    rows = table(spark, d, "part").select(
        "p_partkey", F.concat(F.lit("tsk_"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), F.lit("todo").alias("status"),
        F.when(F.col("p_size") % 7 == 0, "P9").otherwise("P1").alias("priority"), F.lit("M").alias("complexity"), F.when(F.col("p_size") % 5 == 0, "").otherwise("s").alias("sig"), F.lit("i").alias("inc"),
    )
    return incidents.valid_rows(rows).select("p_partkey", F.array_join("problems", ",").alias("problems"))


# ---------------------------------------------------------------- E aggregates
G = "SELECT sig, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, max(seq) AS last_seq, arg_max(source, seq) AS last_source, arg_min(release, seq) AS first_release, arg_max(release, seq) AS last_release FROM r GROUP BY 1"


@query("e1_group_stats", f"WITH {R} {G}")
def group_stats(spark, d):
    return groups.group_stats(records(spark, d))


@query("g1_top_groups", f"WITH {R} {G} ORDER BY n DESC, sig LIMIT 10")
def top_groups(spark, d):
    return groups.top_groups(groups.group_stats(records(spark, d)), 10)


@query("g2_top_recent", f"WITH {R}, g AS ({G}) SELECT * FROM g WHERE last_ts >= TIMESTAMP '2024-01-20' ORDER BY last_seq DESC, sig LIMIT 20")
def top_recent(spark, d):
    return groups.top_groups(groups.group_stats(records(spark, d)), 20, "last_seq", since=now())


@query("g4_groups_since", f"WITH {R}, g AS ({G}) SELECT sig, last_seq FROM g WHERE last_seq > 800 ORDER BY last_seq DESC, sig LIMIT 40")
def groups_since(spark, d):
    return groups.group_stats(records(spark, d)).where("last_seq > 800").orderBy(F.col("last_seq").desc(), "sig").limit(40).select("sig", "last_seq")


@query(
    "e2_snapshots",
    f"WITH {R}, e AS (SELECT * FROM r WHERE kind = 'event'), s AS (SELECT source, arg_max({{'n': k, 'u': seq - 10}}, seq) AS x FROM r WHERE kind = 'event' AND k < 10 GROUP BY 1), c AS (SELECT e.source, count(*) AS more, max(seq) AS top FROM e LEFT JOIN s USING (source) WHERE s.x IS NULL OR seq > s.x.u GROUP BY 1) SELECT coalesce(s.source, c.source) AS source, coalesce(s.x.n, 0) + coalesce(more, 0) AS n, greatest(s.x.u, top) AS last_seq FROM s FULL JOIN c ON s.source = c.source",
)
def snapshots(spark, d):
    events = records(spark, d).where("kind = 'event'")
    taken = events.where("k < 10").select("source", "seq", F.col("k").cast("long").alias("n"), (F.col("seq") - 10).alias("upper_seq"))
    return groups.with_snapshots(events, taken, "source")


@query("e5_counter_deltas", f"WITH {R} SELECT 'host:' || source AS key, count(*) AS n FROM r WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' GROUP BY 1")
def counter_deltas(spark, d):
    inside = records(spark, d).where(F.col("ts").between(F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-12").cast("timestamp")))
    return inside.groupBy(F.concat(F.lit("host:"), F.col("source")).alias("key")).agg(F.count("*").alias("n"))


@query(
    "e6_source_liveness",
    f"WITH {R} SELECT source, max(ts) AS last_ts, max(seq) AS last_seq, count(*) AS n, count_if(ts > TIMESTAMP '2024-01-19' AND kind = 'event') AS events_24h, count_if(ts > TIMESTAMP '2024-01-19' AND kind = 'gap') AS gaps_24h, count_if(ts > TIMESTAMP '2024-01-19' AND kind = 'canary') AS canaries_24h, max(CASE WHEN kind = 'canary' THEN ts END) AS canary_ts FROM r GROUP BY 1",
)
def source_liveness(spark, d):
    return groups.source_liveness(records(spark, d), now())


STATE = "CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN 'recorded' WHEN 2 THEN 'verifying' WHEN 3 THEN 'escalated' ELSE 'resolved' END"
INC = f"i AS (SELECT 'inc_' || (scope % 40) AS inc, seq, ts, {STATE} AS state, CASE WHEN k % 3 = 0 THEN '' ELSE source END AS severity, k = 77 AS refused, kind, sig FROM r)"
FOLD = "SELECT inc, arg_max(CASE WHEN state <> '' THEN state END, CASE WHEN state <> '' THEN seq END) AS state, arg_max(CASE WHEN severity <> '' THEN severity END, CASE WHEN severity <> '' THEN seq END) AS severity, max(ts) AS updated_ts, max(seq) AS last_seq FROM i WHERE NOT refused GROUP BY 1"


def incident_rows(spark, d):
    state = classify.chosen(F.col("k") % 5, [(0, ""), (1, "recorded"), (2, "verifying"), (3, "escalated")], "resolved")
    return records(spark, d).select(
        F.concat(F.lit("inc_"), (F.col("scope") % 40).cast("string")).alias("inc"), "seq", "ts", state.alias("state"), F.when(F.col("k") % 3 == 0, "").otherwise(F.col("source")).alias("severity"), (F.col("k") == 77).alias("refused"), "kind", "sig"
    )


def folded(spark, d):
    return incidents.fold(incident_rows(spark, d), ["state", "severity"], refused=F.col("refused"))


@query("e8_incident_fold", f"WITH {R}, {INC} {FOLD}")
def incident_fold(spark, d):
    return folded(spark, d)


@query("e10_kind_counts", f"WITH {R}, {INC} SELECT inc, count_if(kind = 'event') AS events, count_if(kind = 'gap') AS gaps, count_if(kind = 'canary') AS canaries FROM i GROUP BY 1")
def kind_counts(spark, d):
    counted = groups.kind_counts(incident_rows(spark, d), "inc")
    of = lambda k: F.coalesce(F.try_element_at("kinds", F.lit(k)), F.lit(0).cast("long"))
    return counted.select("inc", of("event").alias("events"), of("gap").alias("gaps"), of("canary").alias("canaries"))


@query(
    "e11_compaction",
    f"WITH {R}, x AS (SELECT strftime(ts, '%Y-%m-%d') AS day, * FROM r) SELECT day, sig, kind, 1::BIGINT AS n, seq AS first_seq, seq AS last_seq, seq::VARCHAR AS seqs, value AS sum_value FROM x WHERE kind <> 'event' UNION ALL SELECT day, sig, 'aggregate', count(*), min(seq), max(seq), array_to_string(list_sort(list(DISTINCT seq)), ','), sum(value) FROM x WHERE kind = 'event' GROUP BY day, sig",
)
def compaction(spark, d):
    out = verify.checked_compaction(records(spark, d), F.col("kind") != "event")
    return out.withColumn("seqs", F.array_join(F.transform("seqs", lambda s: s.cast("string")), ",")).withColumn("sum_value", F.round("sum_value", 6))


@query("e14_islands", f"WITH {R}, x AS (SELECT scope, seq, seq - row_number() OVER (PARTITION BY scope ORDER BY seq) AS run FROM r WHERE k < 60) SELECT scope, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM x GROUP BY scope, run")
def islands(spark, d):
    return verify.islands(records(spark, d).where("k < 60"), "scope")


HOLES = "SELECT day, seq + 1 AS from_seq, nxt - 1 AS to_seq FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, seq, lead(seq) OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY seq) AS nxt FROM r WHERE k % 4 <> 0) WHERE nxt > seq + 1"


@query("e15_seq_holes", f"WITH {R} {HOLES}")
def seq_holes(spark, d):
    return verify.holes(records(spark, d).where("k % 4 <> 0").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "day")


@query(
    "e16_unexplained_holes",
    f"WITH {R}, h AS ({HOLES}), u AS (SELECT from_seq, to_seq, unnest(range(from_seq, to_seq + 1)) AS seq FROM h) SELECT from_seq, to_seq, count(*) AS lost FROM u WHERE seq NOT IN (SELECT seq FROM r WHERE k % 8 = 0) GROUP BY 1, 2",
)
def unexplained(spark, d):
    rows = records(spark, d)
    found = verify.holes(rows.where("k % 4 <> 0").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "day").select("from_seq", "to_seq")
    spans = verify.islands(rows.where("k % 8 = 0").withColumn("one", F.lit(1)), "one")
    return verify.unexplained_holes(found, spans)


@query("e17_verify_report", f"WITH {R}, x AS (SELECT * FROM r WHERE k <> 5) SELECT count(*) AS records, min(seq) AS first_seq, max(seq) AS last_seq, max(seq) - min(seq) + 1 - count(DISTINCT seq) AS missing, CASE WHEN max(seq) - min(seq) + 1 > count(DISTINCT seq) THEN 'seq_holes' ELSE '' END AS errors FROM x")
def verify_report(spark, d):
    return verify.report(records(spark, d).where("k <> 5"))


@query("e19_status", f"WITH {R} SELECT count(*) AS records, max(seq) AS last_seq, max(ts) AS last_ts, count_if(kind = 'gap') AS gaps, sum(CASE WHEN kind = 'gap' AND source = 'signup' THEN k ELSE 0 END)::BIGINT AS est_lost FROM r")
def status(spark, d):
    gap = F.col("kind") == "gap"
    return records(spark, d).agg(F.count("*").alias("records"), F.max("seq").alias("last_seq"), F.max("ts").alias("last_ts"), F.count_if(gap).alias("gaps"), F.sum(F.when(gap & (F.col("source") == "signup"), F.col("k")).otherwise(0)).alias("est_lost"))


@query("e21_refusal_folds", f"WITH {R} SELECT source, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, count(*) AS n, min(ts) AS from_ts, max(ts) AS to_ts FROM r WHERE kind = 'gap' GROUP BY 1, 2")
def refusal_folds(spark, d):
    hour = F.floor(F.unix_timestamp("ts") / 3600).cast("long").alias("hour")
    return records(spark, d).where("kind = 'gap'").groupBy("source", hour).agg(F.count("*").alias("n"), F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"))


@query("e22_due_flushes", f"WITH {R} SELECT source, seq FROM (SELECT source, seq, row_number() OVER (PARTITION BY source ORDER BY seq) AS n FROM r) WHERE n % 100 = 0")
def due_flushes(spark, d):
    return groups.due_flushes(records(spark, d), 100, "source").select("source", "seq")


@query("e23_release_span", f"WITH {R}, x AS (SELECT scope, seq, CASE WHEN k % 2 = 0 THEN '' ELSE release END AS release FROM r) SELECT scope, arg_min(release, seq) AS first_release, arg_max(release, seq) AS last_release FROM x WHERE release <> '' GROUP BY 1")
def release_span(spark, d):
    return groups.release_span(records(spark, d).withColumn("release", F.when(F.col("k") % 2 == 0, "").otherwise(F.col("release"))), "scope")


@query("e25_discards", f"WITH {R} SELECT scope, coalesce(nullif(CASE WHEN k % 2 = 0 THEN source ELSE '' END, ''), nullif(CASE WHEN k % 3 = 0 THEN kind ELSE '' END, ''), 'unknown') AS reason, sum(k)::BIGINT AS quantity FROM r GROUP BY 1, 2")
def discards(spark, d):
    pick = lambda n, c: F.nullif(F.when(F.col("k") % n == 0, F.col(c)).otherwise(""), F.lit(""))
    return records(spark, d).groupBy("scope", F.coalesce(pick(2, "source"), pick(3, "kind"), F.lit("unknown")).alias("reason")).agg(F.sum("k").alias("quantity"))


@query("e27_release_seen", f"WITH {R} SELECT scope, release, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM r GROUP BY 1, 2")
def release_seen(spark, d):
    return records(spark, d).groupBy("scope", "release").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@query("e28_canary_coverage", f"WITH {R} SELECT release, coalesce(max(CASE WHEN kind = 'canary' THEN ts END) >= max(CASE WHEN kind = 'event' THEN ts END), false) AS covered FROM r GROUP BY 1")
def canary_coverage(spark, d):
    latest = lambda k: F.max(F.when(F.col("kind") == k, F.col("ts")))
    return records(spark, d).groupBy("release").agg(F.coalesce(latest("canary") >= latest("event"), F.lit(False)).alias("covered"))


@query("e29_top_sigs", f"WITH {R} SELECT sig, count(*) AS n FROM r WHERE ts > TIMESTAMP '2024-01-20' GROUP BY 1 ORDER BY n DESC, sig LIMIT 5")
def top_sigs(spark, d):
    return records(spark, d).where(F.col("ts") > now()).groupBy("sig").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "sig").limit(5)


@query("e32_budget_counters", f"WITH {R} SELECT strftime(ts, '%Y-%m-%d') AS day, source AS class, count(*) AS used FROM r GROUP BY 1, 2")
def budgets(spark, d):
    return records(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("source").alias("class")).agg(F.count("*").alias("used"))


@query("e33_state_counts", f"WITH {R}, {INC}, f AS ({FOLD}) SELECT state, count(*) AS n FROM f GROUP BY 1")
def state_counts(spark, d):
    return folded(spark, d).groupBy("state").agg(F.count("*").alias("n"))


@query("e34_run_statistics", f"WITH {R} SELECT source AS name, release AS version, count(*) AS applied, count_if(k % 3 = 0) AS success, sum(k % 4)::BIGINT AS refusals, max(ts) AS last_used FROM r GROUP BY 1, 2")
def run_statistics(spark, d):
    return records(spark, d).groupBy(F.col("source").alias("name"), F.col("release").alias("version")).agg(F.count("*").alias("applied"), F.count_if(F.col("k") % 3 == 0).alias("success"), F.sum(F.col("k") % 4).alias("refusals"), F.max("ts").alias("last_used"))


@query("e38_dashboard", f"WITH {R}, {INC}, f AS ({FOLD}) SELECT (SELECT count(*) FROM f WHERE state NOT IN ('resolved', 'suppressed', 'quarantined', '')) AS open_incidents, (SELECT count(DISTINCT sig) FROM r) AS groups, (SELECT count(*) FROM r WHERE ts > (SELECT max(ts) FROM r) - INTERVAL 60 SECOND) AS last_minute")
def dashboard(spark, d):
    rows = records(spark, d)
    newest = rows.agg(F.max("ts").alias("m"))
    recent = rows.crossJoin(F.broadcast(newest)).agg(F.count_if(F.col("ts") > F.col("m") - F.expr("interval 60 seconds")).alias("last_minute"), F.count_distinct("sig").alias("groups"))
    return folded(spark, d).agg(F.count_if(classify.is_open(F.col("state"))).alias("open_incidents")).crossJoin(recent)


@query("e41_gap_intervals", f"WITH {R} SELECT seq, ts AS from_ts, coalesce(CASE WHEN k % 2 = 0 THEN ts + INTERVAL 1 HOUR END, ts) AS to_ts, coalesce(CASE WHEN k % 3 = 0 THEN k END, -1) AS est_lost FROM r WHERE kind = 'gap'")
def gap_intervals(spark, d):
    k = F.col("k")
    return records(spark, d).where("kind = 'gap'").select("seq", F.col("ts").alias("from_ts"), F.coalesce(F.when(k % 2 == 0, F.col("ts") + F.expr("interval 1 hour")), F.col("ts")).alias("to_ts"), F.coalesce(F.when(k % 3 == 0, k), F.lit(-1)).alias("est_lost"))


@query("e47_release_sequence", f"WITH {R}, x AS (SELECT release, min(seq) AS first_seq FROM r GROUP BY 1) SELECT release, dense_rank() OVER (ORDER BY first_seq) AS place FROM x")
def release_sequence(spark, d):
    from pyspark.sql import Window

    first = records(spark, d).groupBy("release").agg(F.min("seq").alias("first_seq"))
    return first.select("release", F.dense_rank().over(Window.orderBy("first_seq")).cast("long").alias("place"))


@query("e54_highest_version", f"WITH {R} SELECT source AS name, max(k) AS version, arg_max(release, (k, seq)) AS row_release FROM r WHERE kind <> 'gap' GROUP BY 1")
def highest_version(spark, d):
    return records(spark, d).where("kind <> 'gap'").groupBy(F.col("source").alias("name")).agg(F.max("k").alias("version"), F.max_by("release", F.struct("k", "seq")).alias("row_release"))


# ---------------------------------------------------------------- F windows
@query(
    "f1_rates",
    f"""WITH {R}, c AS (SELECT source, CAST(floor(epoch(ts) / 60) AS BIGINT) AS m, count(*)::DOUBLE AS c FROM r GROUP BY 1, 2),
    w AS (SELECT source, m, sum(c) OVER (PARTITION BY source ORDER BY m RANGE BETWEEN 0 PRECEDING AND CURRENT ROW) AS s1, sum(c) OVER (PARTITION BY source ORDER BY m RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) AS s5,
      sum(c) OVER (PARTITION BY source ORDER BY m RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS s60, sum(c) OVER (PARTITION BY source ORDER BY m RANGE BETWEEN 9 PRECEDING AND 5 PRECEDING) AS p5 FROM c),
    t AS (SELECT *, coalesce(last_value(CASE WHEN p5 > 0 THEN (s5 / 5) / (p5 / 5) - 1 END IGNORE NULLS) OVER (PARTITION BY source ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS trend FROM w)
    SELECT source, m AS last_minute, s1 AS rate_1m, s5 / 5 AS rate_5m, s60 / 60 AS rate_60m, trend FROM t QUALIFY row_number() OVER (PARTITION BY source ORDER BY m DESC) = 1""",
)
def rates(spark, d):
    return windows.rates(records(spark, d))


@query("f3_hourly_total", f"WITH {R} SELECT source, count_if(floor(epoch(ts) / 3600) > floor(epoch(TIMESTAMP '2024-01-20') / 3600) - 24 AND floor(epoch(ts) / 3600) <= floor(epoch(TIMESTAMP '2024-01-20') / 3600)) AS n FROM r GROUP BY 1")
def hourly(spark, d):
    return windows.hourly_total(records(spark, d), now())


@query("f5_per_minute", f"WITH {R} SELECT seq, count(*) OVER (PARTITION BY source ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS recent FROM r")
def per_minute(spark, d):
    return windows.trailing(records(spark, d), 60, "source").select("seq", "recent")


@query("f6_newest_age", f"WITH {R} SELECT sig, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) // 1000000 AS age_s FROM r GROUP BY 1")
def newest_age(spark, d):
    return records(spark, d).groupBy("sig").agg(F.floor((windows.micros(F.lit("2024-02-01").cast("timestamp")) - windows.micros(F.max("ts"))) / 1_000_000).cast("long").alias("age_s"))


@query("f12_flaps", f"WITH {R} SELECT seq FROM (SELECT seq, count(*) OVER (PARTITION BY scope ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS recent FROM r) WHERE recent > 5")
def flaps(spark, d):
    return windows.flaps(records(spark, d), 86400, 5, "scope").select("seq")


@query(
    "f7_held_for",
    f"""WITH {R}, b AS (SELECT seq, ts, source, value > 3 AS met, sum(CASE WHEN value > 3 THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY seq) AS run FROM r),
    h AS (SELECT seq, met, epoch_us(ts) - min(CASE WHEN met THEN epoch_us(ts) END) OVER (PARTITION BY source, run ORDER BY seq) AS held FROM b) SELECT seq FROM h WHERE met AND held >= 3600 * 1000000::BIGINT""",
)
def held_for(spark, d):
    return windows.held_for(records(spark, d), F.col("value") > 3, 3600, "source").select("seq")


Q = "q AS (SELECT seq, source, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS w, row_number() OVER (PARTITION BY source, floor(epoch(ts) / 3600) ORDER BY seq) AS place, k FROM r)"


@query("f20_quota", f"WITH {R}, {Q} SELECT seq, w, place <= 2 AS admitted FROM q")
def quota(spark, d):
    return windows.quota(records(spark, d), 2, 3600).select("seq", "w", "admitted")


@query("f21_quota_view", f"WITH {R}, {Q}, u AS (SELECT source, w, count_if(place <= 2) AS used, count_if(place > 2) AS refused FROM q GROUP BY 1, 2) SELECT *, lag(used) OVER (PARTITION BY source ORDER BY w) AS before FROM u")
def quota_view(spark, d):
    return windows.quota_view(records(spark, d), 2, 3600)


@query("f22_loss_policy", f"WITH {R}, {Q} SELECT seq, CASE WHEN place <= 2 THEN 'accepted' WHEN source = 'error' AND k % 4 = 0 THEN 'sampled' WHEN source = 'click' THEN 'spooled' ELSE 'dropped' END AS disposition FROM q")
def loss_policy(spark, d):
    policy = classify.chosen(F.col("source"), [("error", "sample"), ("click", "spool")], "drop")
    return windows.quota(records(spark, d), 2, 3600).select("seq", windows.disposition(policy, F.col("k") % 4 == 0).alias("disposition"))


@query(
    "f27_release_diff",
    f"WITH {R}, g AS (SELECT sig, max(release = '1.2') AS o, max(release = '1.3') AS n FROM r WHERE kind = 'event' GROUP BY 1), c AS (SELECT count(*) > 0 AS covered FROM r WHERE kind = 'canary' AND release = '1.3') SELECT sig, CASE WHEN n AND NOT o THEN 'new' WHEN n AND o THEN 'still_open' WHEN covered THEN 'fixed' ELSE 'unproven' END AS status FROM g, c WHERE n OR o",
)
def release_diff(spark, d):
    rows = records(spark, d)
    return windows.release_diff(rows.where("kind = 'event'").select("sig", "release"), rows.where("kind = 'canary'"), "1.2", "1.3")


@query(
    "f33_episodes",
    f"""WITH {R}, o AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY scope ORDER BY ts, seq) > 43200 * 1000000::BIGINT OR lag(ts) OVER (PARTITION BY scope ORDER BY ts, seq) IS NULL THEN 1 ELSE 0 END AS opens FROM r),
    e AS (SELECT *, sum(opens) OVER (PARTITION BY scope ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS episode FROM o) SELECT scope, episode, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM e GROUP BY 1, 2""",
)
def episodes(spark, d):
    return windows.episodes(records(spark, d), 43200)


@query("f45_window_clamp", f"WITH {R} SELECT seq, least(greatest(k * 60, 600), 3600) AS window_s FROM r")
def window_clamp(spark, d):
    return records(spark, d).select("seq", F.least(F.greatest(F.col("k") * 60, F.lit(600)), F.lit(3600)).alias("window_s"))


@query(
    "f47_stalls",
    f"""WITH {R}, m AS (SELECT seq, source, CASE WHEN k // 20 <> lag(k // 20) OVER (PARTITION BY source ORDER BY seq) OR lag(k) OVER (PARTITION BY source ORDER BY seq) IS NULL THEN 1 ELSE 0 END AS moved FROM r),
    n AS (SELECT *, sum(moved) OVER (PARTITION BY source ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY source, run ORDER BY seq) - 1 AS held FROM n) WHERE held >= 2""",
)
def stalls(spark, d):
    return windows.stalled(records(spark, d).withColumn("step", F.floor(F.col("k") / 20)), "step", 2).select("seq")


@query("f51_clock_skew", f"WITH {R} SELECT seq, abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-20')) > 300 * 1000000::BIGINT AS skewed FROM r")
def clock_skew(spark, d):
    return records(spark, d).select("seq", (F.abs(windows.micros("ts") - windows.micros(now())) > 300 * 1_000_000).alias("skewed"))


@query("f69_run_caps", f"WITH {R} SELECT seq FROM (SELECT seq, row_number() OVER (PARTITION BY source, strftime(ts, '%Y-%m-%d') ORDER BY seq) AS nth FROM r) WHERE nth <= 3")
def run_caps(spark, d):
    return windows.capped(records(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), 3, ["source", "day"]).select("seq")


@query("f73_newest_canaries", f"WITH {R} SELECT scope, seq FROM (SELECT scope, seq, row_number() OVER (PARTITION BY scope ORDER BY seq DESC) AS n FROM r WHERE kind = 'canary') WHERE n <= 4")
def newest_canaries(spark, d):
    return incidents.timeline(records(spark, d).where("kind = 'canary'"), 4, "scope").select("scope", "seq")


# ---------------------------------------------------------------- C joins and verdicts
W = "w AS (SELECT 'w' || seq AS wid, sig, scope, ts AS start_ts, ts + INTERVAL 2 DAY AS end_ts FROM r WHERE kind = 'event')"
GAPS = "gp AS (SELECT 'g' || seq AS gid, ts AS from_ts, ts + INTERVAL 30 MINUTE AS to_ts FROM r WHERE kind = 'gap')"


def window_rows(spark, d):
    """A window of two days after every event."""
    rows = records(spark, d).where("kind = 'event'")
    return rows.select(F.concat(F.lit("w"), F.col("seq").cast("string")).alias("wid"), "sig", "scope", F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("interval 2 days")).alias("end_ts"))


def gap_rows(spark, d):
    rows = records(spark, d).where("kind = 'gap'")
    return rows.select(F.concat(F.lit("g"), F.col("seq").cast("string")).alias("gid"), F.col("ts").alias("from_ts"), (F.col("ts") + F.expr("interval 30 minutes")).alias("to_ts"))


@query("c3_gaps_in_windows", f"WITH {R}, {W}, {GAPS} SELECT wid, gid FROM w JOIN gp ON to_ts >= start_ts AND from_ts <= end_ts")
def gaps_in_windows(spark, d):
    return verify.overlapping(window_rows(spark, d), gap_rows(spark, d), 6 * 3600).select("wid", "gid")


@query("c4_events_in_windows", f"WITH {R}, {W} SELECT wid, count(r.seq) AS events FROM w LEFT JOIN r ON r.sig = w.sig AND r.ts BETWEEN start_ts AND end_ts AND r.kind = 'event' GROUP BY 1")
def events_in_windows(spark, d):
    return verify.events_in(window_rows(spark, d), records(spark, d).where("kind = 'event'")).select("wid", "events")


@query("c5_first_canary", f"WITH {R}, {W} SELECT wid, arg_min(r.seq, (r.ts, r.seq)) AS canary FROM w LEFT JOIN r ON r.scope = w.scope AND r.ts >= start_ts AND r.ts < end_ts AND r.kind = 'canary' GROUP BY 1")
def first_canary(spark, d):
    return verify.first_canary(window_rows(spark, d), records(spark, d).where("kind = 'canary'"), "scope").select("wid", "canary")


@query(
    "f44_verdicts",
    f"""WITH {R}, {W}, {GAPS}, c AS (SELECT wid, arg_min(r.seq, (r.ts, r.seq)) AS canary FROM w LEFT JOIN r ON r.scope = w.scope AND r.ts >= start_ts AND r.ts < end_ts AND r.kind = 'canary' GROUP BY 1),
    e AS (SELECT wid, count(r.seq) AS events FROM w LEFT JOIN r ON r.sig = w.sig AND r.ts > start_ts AND r.ts <= end_ts AND r.kind = 'event' GROUP BY 1), g AS (SELECT wid, count(*) AS gaps FROM w JOIN gp ON to_ts >= start_ts AND from_ts <= end_ts GROUP BY 1)
    SELECT wid, CASE WHEN canary IS NULL OR coalesce(gaps, 0) > 0 THEN 'invalid' WHEN events > 0 THEN 'failed' ELSE 'passed' END AS verdict FROM c JOIN e USING (wid) LEFT JOIN g USING (wid)""",
)
def verdicts(spark, d):
    return verdict_rows(spark, d, window_rows(spark, d), gap_rows(spark, d))


def verdict_rows(spark, d, w, gap):
    rows = records(spark, d)
    canary = verify.first_canary(w, rows.where("kind = 'canary'"), "scope").drop("scope")
    events = verify.events_in(canary, rows.where("kind = 'event'"), open_start=True).drop("sig")
    all_of = verify.gaps_in(events, gap)
    return all_of.select("wid", verify.verdict(F.col("canary").isNotNull(), F.lit(0), F.col("gaps"), F.col("events")).alias("verdict"))


@query("c1_evidence", f"WITH {R}, {INC}, x AS (SELECT inc, seq, row_number() OVER (PARTITION BY inc ORDER BY seq DESC) AS n FROM i) SELECT inc, count(*) AS n, count_if(n <= 50) AS kept, count_if(n > 50) AS overflow FROM x GROUP BY 1")
def evidence(spark, d):
    return incidents.evidence(folded(spark, d), incident_rows(spark, d), 50).select("inc", "n", "kept", "overflow")


@query("c6_source_states", f"WITH {R}, x AS (SELECT DISTINCT scope % 7 AS wid, source FROM r), e AS (SELECT DISTINCT scope % 7 AS wid, source FROM r WHERE k = 1), c AS (SELECT DISTINCT scope % 7 AS wid, source FROM r WHERE k IN (2, 3)) SELECT wid::BIGINT AS wid, count_if(e.source IS NOT NULL OR c.source IS NOT NULL) AS alive, count_if(e.source IS NULL AND c.source IS NOT NULL) AS quiet, count_if(e.source IS NULL AND c.source IS NULL) AS missing FROM x LEFT JOIN e USING (wid, source) LEFT JOIN c USING (wid, source) GROUP BY 1")
def source_states(spark, d):
    rows = records(spark, d).select((F.col("scope") % 7).alias("wid"), "source", "k")
    out = verify.source_states(rows.select("wid", "source").distinct(), rows.where("k = 1"), rows.where("k in (2, 3)"))
    return out.select("wid", *(F.size(c).cast("long").alias(c) for c in ("alive", "quiet", "missing")))


@query("c7_alias_map", f"WITH {R} SELECT sig, arg_max(release, seq) AS value FROM r GROUP BY 1")
def alias_map(spark, d):
    return groups.lookup(records(spark, d), "sig", F.col("release"))


@query("c11_titles", "SELECT 'inc_' || o_orderkey AS inc, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END, ''), nullif(CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE '' END, ''), 's' || o_custkey) AS title FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def titles(spark, d):
    inc = table(spark, d, "orders").select(F.concat(F.lit("inc_"), F.col("o_orderkey").cast("string")).alias("inc"), F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("sig"))
    pick = lambda n, c: F.when(F.col("c_custkey") % 3 == n, F.col(c)).otherwise("")
    known = table(spark, d, "customer").select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("sig"), pick(0, "c_name").alias("title"), pick(1, "c_mktsegment").alias("digest"))
    return incidents.titles(inc, known)


@query("c13_latest_before", f"WITH {R}, a AS (SELECT seq, scope, ts FROM r WHERE kind = 'event'), b AS (SELECT scope, ts, release FROM r WHERE kind = 'canary') SELECT seq, b.release FROM a ASOF LEFT JOIN b ON a.scope = b.scope AND a.ts >= b.ts")
def latest_before(spark, d):
    rows = records(spark, d)
    return incidents.latest_before(rows.where("kind = 'event'").select("seq", "scope", "ts"), rows.where("kind = 'canary'").select("scope", "ts", "release"), "scope", "release").select("seq", "release")


@query("c16_skill_versions", "WITH s AS (SELECT p_brand AS sig, p_type AS name, max(p_size) AS version FROM part GROUP BY 1, 2), m AS (SELECT sig, max(version) AS version FROM s GROUP BY 1) SELECT s.sig, min(s.name) AS name, m.version, count(*) > 1 AS tied FROM s JOIN m ON s.sig = m.sig AND s.version = m.version GROUP BY 1, 3")
def skill_versions(spark, d):
    parts = table(spark, d, "part")
    skills = parts.groupBy("p_brand", "p_type").agg(F.max("p_size").alias("version")).groupBy(F.col("p_type").alias("name"), "version").agg(F.collect_list("p_brand").alias("sigs"))
    return incidents.resolve_versions(parts.select(F.col("p_brand").alias("sig")).distinct(), skills)


@query("c17_class_table", "WITH t AS (SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 4 = 0 THEN 'x' || n_nationkey WHEN n_regionkey = 1 THEN 'wild' WHEN n_nationkey % 2 = 0 THEN 'tax' END AS slug FROM nation) SELECT n_nationkey, slug FROM t")
def class_table(spark, d):
    nation = table(spark, d, "nation")
    rows = nation.select("n_nationkey", F.col("n_regionkey").cast("string").alias("source"), F.col("n_name").alias("subject"), F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd").alias("taxonomy"))
    exact = nation.where("n_nationkey % 4 = 0").select(F.col("n_regionkey").cast("string").alias("source"), F.col("n_name").alias("subject"), F.concat(F.lit("x"), F.col("n_nationkey").cast("string")).alias("slug"))
    rest = spark.createDataFrame([("1", "*", "wild"), ("even", "*", "tax")], "source string, subject string, slug string")
    return incidents.classify_by_table(rows, exact.unionByName(rest)).select("n_nationkey", "slug")


@query("c22_not_yet_appended", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def not_yet(spark, d):
    return table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


# ---------------------------------------------------------------- G and H
@query("g3_open_incidents", f"WITH {R}, {INC}, f AS ({FOLD}) SELECT inc, state, updated_ts FROM f WHERE state NOT IN ('resolved', 'suppressed', 'quarantined', '') ORDER BY updated_ts DESC, inc LIMIT 15")
def open_incidents(spark, d):
    return incidents.open_incidents(folded(spark, d), 15).select("inc", "state", "updated_ts")


@query("g5_timeline", f"WITH {R}, {INC} SELECT inc, seq FROM (SELECT inc, seq, row_number() OVER (PARTITION BY inc ORDER BY seq DESC) AS n FROM i) WHERE n <= 10")
def timeline(spark, d):
    return incidents.timeline(incident_rows(spark, d), 10).select("inc", "seq")


@query("g7_newest_gaps", f"WITH {R}, {GAPS} SELECT gid, to_ts FROM gp WHERE to_ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20' ORDER BY to_ts DESC, gid LIMIT 30")
def newest_gaps(spark, d):
    return newest_of(gap_rows(spark, d))


def newest_of(gaps):
    return gaps.where(F.col("to_ts").between(F.lit("2024-01-03").cast("timestamp"), now())).orderBy(F.col("to_ts").desc(), "gid").limit(30).select("gid", "to_ts")


@query("g8_page", f"WITH {R}, p AS (SELECT seq, kind FROM r WHERE kind = 'event' AND seq < 700 ORDER BY seq DESC LIMIT 21) SELECT seq, kind, CASE WHEN (SELECT count(*) FROM p) > 20 THEN (SELECT min(seq) FROM (SELECT seq FROM p ORDER BY seq DESC LIMIT 20)) END AS next FROM (SELECT * FROM p ORDER BY seq DESC LIMIT 20)")
def one_page(spark, d):
    return incidents.page(records(spark, d), 20, 700, "event").select("seq", "kind", "next")


@query("g12_ranking", f"WITH {R} SELECT scope, count(*) AS n, max(value) AS top FROM r GROUP BY 1 ORDER BY top DESC, n DESC, scope LIMIT 12")
def ranking(spark, d):
    return records(spark, d).groupBy("scope").agg(F.count("*").alias("n"), F.max("value").alias("top")).orderBy(F.col("top").desc(), F.col("n").desc(), "scope").limit(12)


@query("g16_spool_eviction", f"WITH {R}, x AS (SELECT source AS driver, seq AS id, ts, k AS attempts, 100 AS bytes, CASE WHEN k >= 95 THEN 'attempts' WHEN ts < TIMESTAMP '2024-01-05' THEN 'ttl' END AS reason FROM r), y AS (SELECT *, sum(CASE WHEN reason IS NULL THEN bytes ELSE 0 END) OVER (PARTITION BY driver ORDER BY ts DESC, id DESC ROWS UNBOUNDED PRECEDING) AS kept, row_number() OVER (PARTITION BY driver ORDER BY ts DESC, id DESC) AS place FROM x) SELECT id, coalesce(reason, CASE WHEN kept > 5000 AND place > 10 THEN 'budget' END) AS reason FROM y WHERE coalesce(reason, CASE WHEN kept > 5000 AND place > 10 THEN 'budget' END) IS NOT NULL")
def spool_eviction(spark, d):
    rows = records(spark, d).select(F.col("source").alias("driver"), F.col("seq").alias("id"), "ts", F.col("k").alias("attempts"), F.lit(100).alias("bytes"))
    return incidents.evicted(rows, 5000, 10, 95, F.col("ts") < F.lit("2024-01-05").cast("timestamp")).select("id", "reason")


@query("h1_union_parts", f"WITH {R} SELECT seq, kind FROM r WHERE kind = 'gap' UNION ALL SELECT seq, kind FROM r WHERE kind = 'canary'")
def union_parts(spark, d):
    rows = records(spark, d).select("seq", "kind")
    return rows.where("kind = 'gap'").unionByName(rows.where("kind = 'canary'"))


@query("h3_missing_sources", f"WITH {R} SELECT DISTINCT source FROM r EXCEPT SELECT DISTINCT source FROM r WHERE ts > TIMESTAMP '2024-01-29 20:00:00'")
def missing_sources(spark, d):
    rows = records(spark, d)
    return rows.select("source").distinct().join(rows.where(F.col("ts") > F.lit("2024-01-29 20:00:00").cast("timestamp")).select("source").distinct(), "source", "left_anti")


@query("h4_distinct_seqs", f"WITH {R} SELECT source, array_to_string(list_sort(list(DISTINCT k)), ',') AS ks FROM r GROUP BY 1")
def distinct_seqs(spark, d):
    return records(spark, d).groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_set("k")), lambda x: x.cast("string")), ",").alias("ks"))
