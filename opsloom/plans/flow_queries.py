"""Queries of flows: gates, leases, caps, breakers, boot holds, restored state, pages, tables, tails."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, parsers
from ..operators import desk, flows, groups, retention, stateful, verify, windows
from ..sources import ledger, scratch
from ..streaming import pipeline
from . import fold_sql, log_queries
from .catalog import oracle_text, query, table
from .source_queries import LOG, written_log
from .stream_queries import FOLD, INC, R, folded, now, records

DAY = 86_400


# ---------------------------------------------------------------- machines of one key
@query("f43_leases", f"WITH {R}, x AS (SELECT 'inc_' || (scope % 40) AS inc, seq, ts FROM r), {fold_sql.LEASES} SELECT inc, o.seq, o.outcome FROM y")
def leases(spark, d):
    return stateful.leases(records(spark, d).select(F.concat(F.lit("inc_"), (F.col("scope") % 40).cast("string")).alias("inc"), "seq", "ts"), DAY)


_MOVE = "CASE WHEN k % 4 = 0 THEN 'commit' WHEN k % 4 = 1 THEN 'release' ELSE 'claim' END"


@query("f46_dedup_gate", f"WITH {R}, x AS (SELECT scope AS key, seq, ts, {_MOVE} AS move FROM r), {fold_sql.GATE} SELECT key, o.seq, o.outcome FROM y")
def dedup_gate(spark, d):
    move = classify.chosen(F.col("k") % 4, [(0, "commit"), (1, "release")], "claim")
    return stateful.dedup_gate(records(spark, d).select(F.col("scope").alias("key"), "seq", "ts", move.alias("move")), DAY)


@query("f40_comment_caps", f"WITH {R}, x AS (SELECT 'p' || (scope % 30) AS sig, seq, ts FROM r), {fold_sql.COMMENTS} SELECT sig, o.seq, o.outcome FROM y")
def comment_caps(spark, d):
    rows = records(spark, d).select(F.concat(F.lit("p"), (F.col("scope") % 30).cast("string")).alias("sig"), "seq", "ts")
    return stateful.comment_caps(rows, [("day", DAY, 2), ("week", 7 * DAY, 6)], DAY / 4)


@query("f35_escalations", f"WITH {R}, x AS (SELECT scope, seq, ts FROM r WHERE kind = 'event'), {fold_sql.ESCALATIONS} SELECT scope, o.seq, o.outcome FROM y")
def escalations(spark, d):
    return stateful.escalations(records(spark, d).where("kind = 'event'").select("scope", "seq", "ts"), 3, DAY)


_ISSUES = f"WITH {R}, x AS (SELECT 'p' || (scope % 30) AS sig, seq, ts, CASE WHEN kind = 'canary' THEN 'close' ELSE 'arrive' END AS move FROM r), {fold_sql.DESK}"


def _desk(spark, d):
    rows = records(spark, d).select(F.concat(F.lit("p"), (F.col("scope") % 30).cast("string")).alias("sig"), "seq", "ts", F.when(F.col("kind") == "canary", "close").otherwise("arrive").alias("move"))
    return stateful.issue_desk(rows, DAY, 3)


@query("f67_ensure_issue", f"{_ISSUES} SELECT sig, o.seq, o.outcome FROM y")
def ensure_issue(spark, d):
    return _desk(spark, d)


@query("f65_reopened_issues", f"{_ISSUES} SELECT sig, o.seq, o.outcome FROM y WHERE o.outcome IN ('reopened', 'superseded')")
def reopened_issues(spark, d):
    return _desk(spark, d).where("outcome in ('reopened', 'superseded')")


@query("f25_retry_folds", f"WITH {R}, {fold_sql.RETRIES} SELECT sig, o.seq, o.first FROM y")
def retry_folds(spark, d):
    return stateful.retry_folds(records(spark, d).select("sig", "seq", "ts"), "sig", DAY)


@query("f63_cut_windows", fold_sql.CUT_WINDOWS)
def cut_windows(spark, d):
    return stateful.folded(records(spark, d).select("sig", "seq", "ts", (F.col("k") % 10 != 0).alias("foldable")), 6 * 3600)


@query("f62_closing_arrivals", f"WITH w AS (SELECT sig, first_seq, first_ts + INTERVAL 6 HOUR AS due FROM ({fold_sql.FOLD_WINDOWS})) SELECT w.sig, w.first_seq, e.ts AS closed FROM w ASOF LEFT JOIN (SELECT DISTINCT ts FROM events) AS e ON w.due <= e.ts")
def closing_arrivals(spark, d):
    """When an arrival of whatever signature closes a window whose time is over."""
    due = log_queries.fold_windows(spark, d).select("sig", "first_seq", (F.col("first_ts") + F.expr("interval 6 hours")).alias("due"))
    return windows.next_arrival(due, records(spark, d), "due", "closed").select("sig", "first_seq", "closed")


@query("f71_rate_limit", f"SELECT * FROM ({fold_sql.TOKEN_BUCKET}) WHERE NOT admitted")
def rate_limit(spark, d):
    """What a bucket refuses."""
    return stateful.token_bucket(records(spark, d).select("scope", "seq", "ts"), 0.001, 2).where("not admitted")


# ---------------------------------------------------------------- parts of the larger machines
@query("f13_probe_verdicts", f"SELECT source, seq, state, trips FROM ({fold_sql.BREAKER}) WHERE probe AND allowed")
def probe_verdicts(spark, d):
    return log_queries.breaker(spark, d).where("probe and allowed").select("source", "seq", "state", "trips")


@query("f53_suppressed_arrivals", f"SELECT source, count(*) AS suppressed FROM ({fold_sql.BREAKER}) WHERE NOT allowed GROUP BY 1")
def suppressed_arrivals(spark, d):
    return log_queries.breaker(spark, d).where("not allowed").groupBy("source").agg(F.count("*").alias("suppressed"))


@query("f54_new_incidents", f"SELECT key, seq, incident FROM ({fold_sql.ADMISSION}) WHERE outcome = 'created'")
def new_incidents(spark, d):
    return log_queries.admission(spark, d).where("outcome = 'created'").select("key", "seq", "incident")


@query("f55_refused_moves", f"SELECT inc, count_if(refused) AS refused, count_if(refused AND edge = 'T47') AS quarantined FROM ({fold_sql.TRANSITIONS}) GROUP BY 1")
def refused_moves(spark, d):
    moves = log_queries.transitions(spark, d)
    return moves.groupBy("inc").agg(F.count_if("refused").alias("refused"), F.count_if(F.col("refused") & (F.col("edge") == "T47")).alias("quarantined"))


@query("f57_suppressions", f"WITH t AS ({fold_sql.TRANSITIONS}), u AS (SELECT *, lead(seq) OVER (PARTITION BY inc ORDER BY seq) AS until_seq FROM t WHERE NOT refused) SELECT inc, seq AS from_seq, until_seq FROM u WHERE to_state IN ('resolved', 'escalated', 'quarantined', 'suppressed')")
def suppressions(spark, d):
    return flows.suppressions(log_queries.transitions(spark, d), ("resolved", "escalated", "quarantined", "suppressed"))


@query("c20_journal_attachments", f"SELECT unit, seq, class FROM ({fold_sql.ARRIVALS}) WHERE outcome = 'attached' AND seq IN (SELECT event_id + 1 FROM events WHERE event_type = 'view')")
def journal_attachments(spark, d):
    lines = records(spark, d).where("source = 'view'").select("seq")
    return log_queries.arrivals(spark, d).where("outcome = 'attached'").join(lines, "seq", "left_semi").select("unit", "seq", "class")


@query("f56_rungs_to_try", f"WITH {R}, {INC}, f AS ({FOLD}) SELECT inc, CASE WHEN state = 'recorded' THEN CASE severity WHEN 'error' THEN 'play,research,agent' WHEN 'click' THEN 'play,research' WHEN 'view' THEN 'play' ELSE '' END ELSE '' END AS rungs FROM f")
def rungs_to_try(spark, d):
    ceiling = classify.chosen(F.col("severity"), [("error", "agent"), ("click", "research"), ("view", "play")], "record")
    return flows.rungs_to_try(folded(spark, d).withColumn("ceiling", ceiling)).select("inc", F.array_join("rungs", ",").alias("rungs"))


# ---------------------------------------------------------------- rates, breakers, boots, restored state
@query("f2_trends", oracle_text("f1_rates").replace("SELECT source, m AS last_minute, s1 AS rate_1m, s5 / 5 AS rate_5m, s60 / 60 AS rate_60m, trend FROM t", "SELECT source, trend FROM t"))
def trends(spark, d):
    return windows.rates(records(spark, d)).select("source", "trend")


@query("f4_events_between", f"WITH {R} SELECT sig, count(*) AS n FROM r WHERE kind = 'event' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' GROUP BY 1")
def events_between(spark, d):
    inside = F.col("ts").between(F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-12").cast("timestamp"))
    return records(spark, d).where((F.col("kind") == "event") & inside).groupBy("sig").agg(F.count("*").alias("n"))


@query("f8_carried_timers", f"WITH {R}, t AS (SELECT DISTINCT 'rule' || (k % 10) AS rule, 'fp' || (k % 3) AS fingerprint, sig FROM r) SELECT * FROM t WHERE (rule, fingerprint) IN (SELECT 'rule' || j, 'fp' || (j % 3) FROM unnest(range(0, 8)) AS u(j))")
def carried_timers(spark, d):
    named = lambda p, n: F.concat(F.lit(p), (F.col("k") % n).cast("string"))
    timers = records(spark, d).select(named("rule", 10).alias("rule"), named("fp", 3).alias("fingerprint"), "sig").distinct()
    rules = spark.range(8).select(F.concat(F.lit("rule"), F.col("id").cast("string")).alias("rule"), F.concat(F.lit("fp"), (F.col("id") % 3).cast("string")).alias("fingerprint"))
    return flows.carried_over(timers, rules)


@query("f11_trailing_rate", f"WITH {R} SELECT seq, count(*) OVER (PARTITION BY scope ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS recent FROM r")
def trailing_rate(spark, d):
    return windows.trailing(records(spark, d), 3600, "scope").select("seq", "recent")


@query("f19_boot_holds", f"WITH {R} SELECT seq, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY source) < 7 * 86400 * 1000000::BIGINT AS held FROM r")
def boot_holds(spark, d):
    return flows.boot_holds(records(spark, d), 7 * DAY).select("seq", "held")


@query("f60_drain_batches", f"WITH {R}, h AS (SELECT *, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY source) < 7 * 86400 * 1000000::BIGINT AS held FROM r) SELECT source, seq, (row_number() OVER (PARTITION BY source ORDER BY ts, seq) - 1) // 25 AS batch FROM h WHERE held")
def drain_batches(spark, d):
    return flows.drained(flows.boot_holds(records(spark, d), 7 * DAY).where("held"), 25).select("source", "seq", "batch")


@query("f61_recovered_units", f"WITH {R}, l AS (SELECT scope, arg_max(kind, seq) AS last FROM r GROUP BY 1) SELECT DISTINCT scope FROM r WHERE kind = 'gap' AND scope NOT IN (SELECT scope FROM l WHERE last = 'event')")
def recovered_units(spark, d):
    rows = records(spark, d)
    failed = rows.groupBy("scope").agg(F.max_by("kind", "seq").alias("last")).where("last = 'event'")
    return flows.recovered(rows.where("kind = 'gap'"), failed)


@query("f34_open_times", f"WITH {R}, m AS (SELECT scope, seq, CASE WHEN kind = 'canary' THEN 'close' ELSE 'trip' END AS move FROM r), n AS (SELECT *, sum(CASE WHEN move = 'close' THEN 1 ELSE 0 END) OVER (PARTITION BY scope ORDER BY seq) AS run FROM m) SELECT scope, seq, least(1800.0 * power(2, row_number() OVER (PARTITION BY scope, run ORDER BY seq) - 1), 14400.0)::DOUBLE AS seconds FROM n WHERE move = 'trip'")
def open_times(spark, d):
    rows = records(spark, d).withColumn("move", F.when(F.col("kind") == "canary", "close").otherwise("trip"))
    return flows.open_times(rows, 1800, 14400).select("scope", "seq", "seconds")


@query("f72_closed_by_proof", f"WITH {R}, h AS (SELECT scope, min(ts) AS since FROM r WHERE kind = 'gap' GROUP BY 1) SELECT h.scope, h.since, min(r.ts) AS closed FROM h LEFT JOIN r ON r.scope = h.scope AND r.kind = 'canary' AND r.ts >= h.since GROUP BY 1, 2")
def closed_by_proof(spark, d):
    rows = records(spark, d)
    return flows.closed_by_proof(rows.where("kind = 'gap'").groupBy("scope").agg(F.min("ts").alias("since")), rows.select("scope", "ts", (F.col("kind") == "canary").alias("passed")))


@query("f49_canary_misses", f"WITH {R}, c AS (SELECT scope, max(ts) AS t FROM r WHERE kind = 'canary' GROUP BY 1) SELECT scope, coalesce(epoch_us(TIMESTAMP '2024-01-20') - epoch_us(t) > 2 * 3 * 86400 * 1000000::BIGINT, true) AS missed FROM (SELECT DISTINCT scope FROM r) LEFT JOIN c USING (scope)")
def canary_misses(spark, d):
    rows = records(spark, d)
    return flows.canary_misses(rows.where("kind = 'canary'"), rows.select("scope").distinct(), now(), 3 * DAY)


@query("f50_convergence_map", f"WITH {R}, s AS (SELECT sig, max(ts) AS ts FROM r GROUP BY 1) SELECT sig FROM s WHERE epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts) <= 5 * 86400 * 1000000::BIGINT ORDER BY ts DESC, sig LIMIT 64")
def convergence_map(spark, d):
    return flows.recent_most(records(spark, d).groupBy("sig").agg(F.max("ts").alias("ts")), now(), 5 * DAY, 64, "sig").select("sig")


@query("f58_week_strikes", f"WITH {R} SELECT seq, count(*) OVER (PARTITION BY scope ORDER BY epoch_us(ts) RANGE BETWEEN 604799999999 PRECEDING AND CURRENT ROW) AS strikes FROM r WHERE source = 'error'")
def week_strikes(spark, d):
    return desk.strikes(records(spark, d).where("source = 'error'"), 7, 1, "scope").select("seq", "strikes")


@query("f59_parked", f"WITH {R}, p AS (SELECT scope, arg_max(source, seq) AS source, max(seq) AS seq, arg_max(ts, seq) AS ts FROM r GROUP BY 1) SELECT scope, seq, CASE WHEN source = 'click' THEN 'check_only' ELSE 'resume' END AS mode FROM p WHERE ts + INTERVAL 3 DAY > TIMESTAMP '2024-01-20'")
def parked(spark, d):
    rows = records(spark, d).select("scope", "seq", F.when(F.col("source") == "click", "play").otherwise("agent").alias("kind"), (F.col("ts") + F.expr("interval 3 days")).alias("until"))
    return flows.parked(rows, now()).select("scope", "seq", "mode")


@query("f64_restored_keys", f"WITH {R} SELECT seq, scope IN (SELECT scope FROM r WHERE seq <= 40) AND ts < TIMESTAMP '2024-01-10' AS duplicate FROM r")
def restored_keys(spark, d):
    rows = records(spark, d)
    return flows.known_keys(rows, rows.where("seq <= 40"), F.lit("2024-01-10").cast("timestamp"), "scope").select("seq", "duplicate")


@query("f68_acked_comments", f"WITH {R}, a AS (SELECT scope, ts AS from_ts, ts + INTERVAL 12 HOUR AS until_ts FROM r WHERE kind = 'canary') SELECT seq, EXISTS (SELECT 1 FROM a WHERE a.scope = r.scope AND r.ts >= from_ts AND r.ts < until_ts) AS suppressed FROM r WHERE kind = 'event'")
def acked_comments(spark, d):
    rows = records(spark, d)
    acks = rows.where("kind = 'canary'").select("scope", F.col("ts").alias("from_ts"), (F.col("ts") + F.expr("interval 12 hours")).alias("until_ts"))
    return desk.suppressed(rows.where("kind = 'event'"), acks).select("seq", "suppressed")


@query("f70_stale_canaries", f"WITH {R} SELECT seq, epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts) > 7 * 86400 * 1000000::BIGINT AS expired FROM r WHERE kind = 'canary'")
def stale_canaries(spark, d):
    return flows.unexpired(records(spark, d).where("kind = 'canary'"), now(), 7 * DAY).select("seq", "expired")


@query("f66_close_gates", f"WITH {R}, i AS (SELECT scope, max(ts) AS t, max(k) > 50 AS resolved, count_if(kind = 'canary') > 0 AS canary, count_if(kind = 'gap' AND k = 9) = 0 AS complete, scope % 3 <> 0 AS automatic FROM r GROUP BY 1) SELECT scope, array_to_string(list_filter([CASE WHEN t > TIMESTAMP '2024-01-20' THEN 'quiet' END, CASE WHEN NOT resolved THEN 'resolved' END, CASE WHEN NOT canary THEN 'canary' END, CASE WHEN NOT complete THEN 'complete' END, CASE WHEN NOT automatic THEN 'automatic' END], lambda x: x IS NOT NULL), ',') AS blocked FROM i")
def close_gates(spark, d):
    rows = records(spark, d).groupBy("scope").agg(F.max("ts").alias("last_ts"), F.when(F.max("k") > 50, "resolved").otherwise("verifying").alias("state"), (F.count_if(F.col("kind") == "canary") > 0).alias("canary_seen"), F.count_if((F.col("kind") == "gap") & (F.col("k") == 9)).alias("gaps"))
    return desk.quiet_gates(rows.withColumn("manual", F.col("scope") % 3 == 0), 0, now()).select("scope", F.array_join("blocked_by", ",").alias("blocked"))


# ---------------------------------------------------------------- folds without an index, rebuilt groups
@query("e9_cold_incident", f"WITH {R}, {INC} SELECT inc, arg_max(state, seq) AS state, arg_max(severity, seq) AS severity, max(seq) AS seq FROM i GROUP BY 1")
def cold_incident(spark, d):
    from .stream_queries import incident_rows

    return incident_rows(spark, d).groupBy("inc").agg(F.max_by("state", "seq").alias("state"), F.max_by("severity", "seq").alias("severity"), F.max("seq").alias("seq"))


@query("e18_lock_free_verify", f"WITH {LOG} SELECT count(*) AS records, min(seq) AS first_seq, max(seq) AS last_seq, max(seq) - min(seq) + 1 - count(DISTINCT seq) AS missing FROM aus WHERE state = 'ok'")
def lock_free_verify(spark, d):
    return verify.report(ledger.read(spark, written_log(spark, d))).drop("errors")


_SNAP = "s AS (SELECT scope, arg_max({'n': k, 'u': seq - 10}, seq) AS x FROM r WHERE kind = 'canary' GROUP BY 1)"


def _snapshots(spark, d):
    rows = records(spark, d)
    return rows.where("kind = 'event'"), rows.where("kind = 'canary'").select("scope", "seq", F.col("k").cast("long").alias("n"), (F.col("seq") - 10).alias("upper_seq"))


@query("e24_rebuilt_groups", f"WITH {R}, {_SNAP}, c AS (SELECT e.scope, count(*) AS more, max(seq) AS top FROM r AS e LEFT JOIN s USING (scope) WHERE e.kind = 'event' AND (s.x IS NULL OR e.seq > s.x.u) GROUP BY 1) SELECT scope, coalesce(x.n, 0) + coalesce(more, 0) AS n, greatest(x.u, top) AS last_seq FROM s FULL JOIN c USING (scope)")
def rebuilt_groups(spark, d):
    return groups.with_snapshots(*_snapshots(spark, d), "scope")


@query("e44_replayed_events", f"WITH {R}, {_SNAP} SELECT e.seq FROM r AS e LEFT JOIN s USING (scope) WHERE e.kind = 'event' AND (s.x IS NULL OR e.seq > s.x.u)")
def replayed_events(spark, d):
    return groups.to_replay(*_snapshots(spark, d), "scope").select("seq")


@query("e45_flushed_snapshots", f"WITH {R} SELECT source, seq, n FROM (SELECT source, seq, row_number() OVER (PARTITION BY source ORDER BY seq) AS n FROM r) WHERE n % 50 = 0")
def flushed_snapshots(spark, d):
    return groups.due_flushes(records(spark, d), 50, "source").select("source", "seq", F.col("nth").cast("long").alias("n"))


@query("e42_open_without_index", f"WITH {R}, {INC}, f AS ({FOLD}) SELECT inc, state FROM f WHERE coalesce(state, '') NOT IN ('resolved', 'suppressed', 'quarantined', '')")
def open_without_index(spark, d):
    return folded(spark, d).where(classify.is_open(F.col("state"))).select("inc", "state")


# ---------------------------------------------------------------- parsers, blocks, tables, pages, bodies
@query("f29_silence", "WITH x AS (SELECT doc_id::VARCHAR AS source, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents), m AS (SELECT *, regexp_matches(text, '^[A-Z]') AS begins, regexp_matches(text, '^[a-z]|^$') AND line_no <= 1 AS goes_on FROM x), b AS (SELECT *, sum(CASE WHEN begins OR NOT goes_on THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY line_no) AS block FROM m) SELECT source, min(line_no) AS first_line, count(*) AS lines FROM b GROUP BY source, block HAVING arg_min(begins, line_no)")
def silence(spark, d):
    """Lines come ever further apart: after the second one silence ends every block."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    n = F.col("line_no").cast("long")
    lines = docs.select("source", n.alias("line_no"), F.timestamp_seconds(n * n).alias("ts"), "text")
    return stateful.assembled(lines, r"^[A-Z]", r"^[a-z]|^$", silence=2.0).select("source", "first_line", "lines")


@query("f31_py_tracebacks", "SELECT s_suppkey, 'ValueError: bad ' || s_suppkey AS title, 2 AS frames, '/app/w' || s_suppkey || '.py' AS file, true AS in_app FROM supplier")
def py_tracebacks(spark, d):
    n = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit('Traceback (most recent call last):\n  File "/app/w'), n, F.lit('.py", line 3, in f\n    g()\n  File "/usr/lib/python3/site-packages/y.py", line 9, in g\nValueError: bad '), n)
    p = parsers.py_traceback(text)
    return table(spark, d, "supplier").select("s_suppkey", p["title"].alias("title"), F.size(p["frames"]).alias("frames"), p["frames"][0]["filename"].alias("file"), p["frames"][0]["in_app"].alias("in_app"))


@query("f32_node_rejections", "SELECT s_suppkey, 'TypeError: x ' || s_suppkey AS title, 2 AS frames, 'run' AS function, false AS last_in_app FROM supplier")
def node_rejections(spark, d):
    text = F.concat(F.lit("TypeError: x "), F.col("s_suppkey").cast("string"), F.lit("\n    at run (/app/a.js:3:7)\n    at next (/app/node_modules/b/c.js:9:1)"))
    p = parsers.node_reject(text)
    return table(spark, d, "supplier").select("s_suppkey", p["title"].alias("title"), F.size(p["frames"]).alias("frames"), p["frames"][0]["function"].alias("function"), p["frames"][1]["in_app"].alias("last_in_app"))


@query("i4_parser_table", "SELECT * FROM (VALUES ('go-panic', 'panic: x', true, false), ('go-panic', 'goroutine 7 [running]:', false, true), ('go-panic', 'hello there', false, false), ('py-traceback', 'Traceback (most recent call last):', true, false), ('py-traceback', '  File \"x\"', false, true), ('node-reject', 'Uncaught x', true, false), ('node-reject', '    at f (/a.js:1:1)', false, true)) AS v(parser, line, begins, goes_on)")
def parser_table(spark, d):
    rows = [("go-panic", "panic: x"), ("go-panic", "goroutine 7 [running]:"), ("go-panic", "hello there"), ("py-traceback", "Traceback (most recent call last):"), ("py-traceback", '  File "x"'), ("node-reject", "Uncaught x"), ("node-reject", "    at f (/a.js:1:1)")]
    df = spark.createDataFrame(rows, "parser string, line string")
    test = lambda i: F.coalesce(*(F.when(F.col("parser") == n, F.col("line").rlike(b[i])) for n, b in parsers.BLOCKS.items()))
    return df.select("parser", "line", test(0).alias("begins"), test(1).alias("goes_on"))


@query("i6_merged_table", "SELECT n_nationkey AS key, CASE WHEN n_regionkey = 2 THEN 'mine' ELSE n_name END AS slug FROM nation UNION ALL SELECT 1000, 'added'")
def merged_table(spark, d):
    nation = table(spark, d, "nation").withColumn("key", F.col("n_nationkey").cast("long"))
    user = nation.where("n_regionkey = 2").select("key", F.lit("mine").alias("slug")).unionByName(spark.createDataFrame([(1000, "added")], "key long, slug string"))
    return flows.merged_table(nation.select("key", F.col("n_name").alias("slug")), user, ["key"], "slug")


@query("g9_page_starts", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'token_invalid' WHEN 1 THEN 'token_foreign' WHEN 2 THEN 'generation_dropped' END AS reset, CASE c_custkey % 5 WHEN 3 THEN 60 WHEN 4 THEN 100 END AS \"end\" FROM customer")
def page_starts(spark, d):
    name = classify.chosen(F.col("c_custkey") % 5, [(0, "nonsense"), (1, "2023-01-01.g0.p0001.jsonl"), (2, "2024-01-02.g0.p0001.jsonl")], "2024-01-02.g1.p0001.jsonl")
    tokens = table(spark, d, "customer").select("c_custkey", name.alias("generation"), F.when(F.col("c_custkey") % 5 == 3, 60).otherwise(500).alias("offset"), F.lit(7).alias("seq"))
    files = spark.createDataFrame([("2024-01-02.g1.p0001.jsonl", 100)], "file string, size int")
    return flows.resolved_tokens(tokens, files, "2024-01-01").select("c_custkey", "reset", "end")


@query("c25_landed_rows", f"WITH {R} SELECT seq FROM r WHERE k % 2 = 0 AND source IN (SELECT source FROM r WHERE kind = 'gap' OR release = '1.3')")
def landed_rows(spark, d):
    rows = records(spark, d)
    commits = rows.select(F.col("source").alias("commit"), F.when((F.col("kind") == "gap") | (F.col("release") == "1.3"), "main").otherwise("draft").alias("branch"))
    done = rows.select("seq", F.col("source").alias("commit"), F.when(F.col("k") % 2 == 0, "done").otherwise("todo").alias("status"))
    return flows.landed(done, commits, ("main", "release")).select("seq")


@query("d48_escaped_units", "SELECT s_suppkey, 'a_2db_2e' || s_suppkey || '_c3_a9' AS escaped FROM supplier")
def escaped_units(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", classify.escape_unit(F.concat(F.lit("a-b."), F.col("s_suppkey").cast("string"), F.lit("é"))).alias("escaped"))


@query("d107_body_caps", "SELECT doc_id, length(coalesce(text, '')) > 900 AS cut FROM documents")
def body_caps(spark, d):
    """Bodies over the size are cut in the middle of their evidence, and never exceed it."""
    rows = table(spark, d, "documents").select("doc_id", F.lit("s").alias("sig"), F.lit("t").alias("title"), F.coalesce("text", F.lit("")).alias("evidence"))
    head = len("<!-- sig: s -->\n## t\n| field | value |\n|---|---|")
    body = desk.issue_body("title", [], "evidence", most=head + 16 + 900)
    return rows.select("doc_id", (F.contains(body, F.lit("\n...\n")) & (F.length(body) <= head + 16 + 900)).alias("cut"))


# ---------------------------------------------------------------- queues and tails
@query("a28_bounded_queue", f"WITH {R}, n AS (SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY seq DESC) AS n FROM r) SELECT scope, count_if(n <= 5) AS kept, count_if(n > 5) AS dropped FROM n GROUP BY 1")
def bounded_queue(spark, d):
    rows = records(spark, d)
    gone = retention.over_count(rows, 5, "scope").groupBy("scope").agg(F.count("*").alias("dropped"))
    total = rows.groupBy("scope").agg(F.count("*").alias("n")).join(gone, "scope", "left")
    dropped = F.coalesce("dropped", F.lit(0).cast("long"))
    return total.select("scope", (F.col("n") - dropped).alias("kept"), dropped.alias("dropped"))


@query("a40_file_tail", "SELECT count(*) AS lines FROM events")
def file_tail(spark, d):
    """Lines of growing files: what a second start finds is only what is new."""
    path = scratch.folder(spark, "tail")
    lines = table(spark, d, "events").select(F.col("event_id").cast("string").alias("value"), (F.col("event_id") % 2).alias("half"))
    for half in (0, 1):
        lines.where(F.col("half") == half).select("value").write.mode("append").text(f"{path}/logs")
        pipeline.start(pipeline.tail_stream(spark, f"{path}/logs"), f"{path}/checkpoint", lambda batch, n: batch.write.mode("append").parquet(f"{path}/out")).awaitTermination()
    return spark.read.parquet(f"{path}/out").agg(F.count("*").alias("lines"))


@query("a41_after_cursor", f"WITH {R} SELECT seq FROM r WHERE seq > 700")
def after_cursor(spark, d):
    """A journal is followed from the cursor that was kept."""
    return records(spark, d).where(F.col("seq") > 700).select("seq")


@query("a43_replayed_batches", "SELECT count(*) AS records, count(*) AS different FROM events")
def replayed_batches(spark, d):
    """Acknowledged only after the append: a batch that comes again changes nothing."""
    path = scratch.folder(spark, "replay")
    sink = pipeline.ledger_sink(path)
    batch = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.lit("event").alias("kind"), F.col("event_type").alias("sig"), F.col("props").alias("payload"))
    for _ in range(2):
        sink(batch, 7)
    back = spark.read.schema("seq long").option("recursiveFileLookup", True).json(f"{path}/records")
    return back.agg(F.count("*").alias("records"), F.count_distinct("seq").alias("different"))
