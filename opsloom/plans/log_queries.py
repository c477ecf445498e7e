"""Queries whose answer depends on the order of a key's rows; tests hold the operators against sequential versions besides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, parsers, signature
from ..operators import stateful
from ..sources import envelopes, observations
from . import fold_sql
from .catalog import query, table
from .stream_queries import R, records


@query("f9_cooldown", fold_sql.COOLDOWN)
def cooldown(spark, d):
    return stateful.cooled(records(spark, d).select("source", "scope", "seq", "ts"), 86400, ["source", "scope"]).select("seq")


@query("f10_breaker", fold_sql.BREAKER)
def breaker(spark, d):
    """A rush: a record every seven seconds, so that breakers trip, probe and close."""
    return stateful.breaker(records(spark, d).select("source", "seq", F.timestamp_seconds(F.col("seq") * 7).alias("ts")), 2, base=600, longest=7200)


@query("f14_fold_windows", fold_sql.FOLD_WINDOWS)
def fold_windows(spark, d):
    return stateful.folded(records(spark, d).select("sig", "seq", "ts"), 6 * 3600)


@query("f15_arrivals", fold_sql.ARRIVALS)
def arrivals(spark, d):
    path = classify.chosen(F.col("source"), [("error", "properties_changed"), ("click", "job_removed"), ("view", "journald"), ("signup", "resolved")], "reconcile")
    rows = records(spark, d).select(
        F.concat(F.lit("unit"), (F.col("scope") % 9).cast("string")).alias("unit"), "seq", "ts", path.alias("path"), F.when(F.col("k") % 3 == 0, "failed").otherwise("active").alias("substate"), F.when(F.col("source") == "click", F.when(F.col("k") % 2 == 0, "failed").otherwise("done")).alias("job_result")
    )
    return stateful.merged_arrivals(rows)


@query("f16_admission", fold_sql.ADMISSION)
def admission(spark, d):
    rows = records(spark, d).select(
        F.concat(F.lit("k"), (F.col("scope") % 20).cast("string")).alias("key"), "seq", "ts", (F.col("seq") % 700).cast("string").alias("event_id"), "sig", (F.col("source") == "view").alias("suppressed"), ((F.col("source") == "signup") & (F.col("k") % 5 == 0)).alias("resolves")
    )
    return stateful.admitted(rows, 86400)


@query("f17_transitions", fold_sql.TRANSITIONS)
def transitions(spark, d):
    triggers = [e[3] for e in stateful.EDGES]
    trigger = F.element_at(F.array(*map(F.lit, triggers)), (F.col("k") % len(triggers) + 1).cast("int"))
    return stateful.transitions(records(spark, d).select(F.concat(F.lit("inc_"), F.col("scope").cast("string")).alias("inc"), "seq", trigger.alias("trigger")))


_EDGES = ", ".join(f"('{e}', '{s}', '{t}', '{g}')" for e, fs, t, g in stateful.EDGES for s in fs.split())


@query("f18_legal_edges", f"SELECT from_state, trigger, min(edge) AS edge, arg_min(to_state, edge) AS to_state FROM (VALUES {_EDGES}) AS v(edge, from_state, to_state, trigger) GROUP BY 1, 2")
def legal_edges(spark, d):
    return stateful.legal_edges(spark).groupBy("from_state", "trigger").agg(F.min("edge").alias("edge"), F.min_by("to_state", "edge").alias("to_state"))


@query("f23_token_bucket", fold_sql.TOKEN_BUCKET)
def token_bucket(spark, d):
    return stateful.token_bucket(records(spark, d).select("scope", "seq", "ts"), 0.001, 2)


@query("f24_event_dedup", fold_sql.EVENT_DEDUP)
def event_dedup(spark, d):
    return stateful.deduplicated(records(spark, d).select("sig", "seq", "ts"), "sig", 86400).select("seq", "duplicate")


@query("f39_create_caps", fold_sql.CREATE_CAPS)
def create_caps(spark, d):
    return stateful.create_caps(records(spark, d).select("scope", "seq", "ts"), [("day", 86400, 2), ("week", 7 * 86400, 8)])


@query("f28_log_blocks", fold_sql.LOG_BLOCKS)
def log_blocks(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    lines = docs.select("source", F.col("line_no").cast("long").alias("line_no"), F.timestamp_seconds(F.col("line_no")).alias("ts"), "text")
    return stateful.assembled(lines, r"^[A-Z]", r"^[a-z]|^$")


@query("f30_go_panics", "SELECT s_suppkey, 'boom ' || s_suppkey AS title, 1::INTEGER AS frames, '/app/w' || s_suppkey || '.go' AS file FROM supplier")
def go_panics(spark, d):
    """One synthetic panic for each supplier, assembled and parsed."""
    n = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("panic: boom "), n, F.lit("\ngoroutine 1 [running]:\nmain.work(0x1)\n\t/app/w"), n, F.lit(".go:7 +0x1\n"))
    p = parsers.go_panic(text)
    return table(spark, d, "supplier").select("s_suppkey", p["title"].alias("title"), F.size(p["frames"]).alias("frames"), p["frames"][0]["filename"].alias("file"))


@query("a36_sdk_events", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'fatal' ELSE 'error' END AS level, 'user ' || user_id AS message, event_id % 2 = 0 AS tagged FROM events")
def sdk_events(spark, d):
    e = table(spark, d, "events")
    item = F.to_json(
        F.struct(
            F.when(F.col("event_type") == "error", "FATAL").otherwise("strange").alias("level"), F.struct(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("formatted")).alias("message"),
            F.when(F.col("event_id") % 2 == 0, F.array(F.struct(F.lit("k").alias("key"), F.lit("v").alias("value")))).alias("tags"),
        )
    )
    rows = envelopes.events(e.select(F.col("event_id").alias("row_id"), item.alias("item")))
    return rows.select(F.col("row_id").alias("event_id"), "level", "message", F.coalesce(F.try_element_at("tags", F.lit("k")) == "v", F.lit(False)).alias("tagged"))


@query("a37_generic_events", "SELECT event_id, event_type AS message, 'unknown:odd' AS causes FROM events")
def generic_events(spark, d):
    value = F.to_json(F.struct(F.col("event_type").alias("message"), F.lit(1).alias("odd")))
    out = envelopes.generic_events(table(spark, d, "events").select(F.col("event_id").alias("row_id"), value.alias("value")))
    return out.select(F.col("row_id").alias("event_id"), "message", F.array_join("causes", ",").alias("causes"))


@query("a39_client_reports", f"WITH {R} SELECT seq, source AS reason, k AS quantity FROM r")
def client_reports(spark, d):
    report = F.to_json(F.struct(F.col("ts").cast("string").alias("timestamp"), F.array(F.struct(F.col("source").alias("reason"), F.lit("error").alias("category"), F.col("k").alias("quantity"))).alias("discarded_events")))
    return envelopes.discards(records(spark, d).select("seq", report.alias("item"))).select("seq", "reason", "quantity")


@query("a26_journal_entries", "SELECT event_id, CASE WHEN event_id % 7 <= 2 THEN 'critical' WHEN event_id % 7 = 3 THEN 'high' WHEN event_id % 7 = 4 THEN 'medium' ELSE 'low' END AS severity, 'retry # of ' || event_type AS norm FROM events")
def journal_entries(spark, d):
    e = table(spark, d, "events")
    line = F.to_json(
        F.struct(
            F.col("event_id").cast("string").alias("__CURSOR"), F.concat(F.lit("retry "), F.col("user_id").cast("string"), F.lit(" of "), F.col("event_type")).alias("MESSAGE"), (F.col("event_id") % 7).cast("string").alias("PRIORITY"), F.lit("a.service").alias("_SYSTEMD_UNIT")
        )
    )
    return observations.journal(e.select(line.alias("value"))).select(F.col("cursor").cast("long").alias("event_id"), "severity", "norm")


@query("a24_pressure_files", "SELECT s_suppkey, (s_suppkey % 60 + 0.5)::DOUBLE AS some_avg10, CASE WHEN s_suppkey % 60 + 0.5 < 10 THEN 'b1' WHEN s_suppkey % 60 + 0.5 < 25 THEN 'b2' WHEN s_suppkey % 60 + 0.5 < 50 THEN 'b3' ELSE 'b4' END AS bucket FROM supplier")
def pressure_files(spark, d):
    text = F.concat(F.lit("some avg10="), (F.col("s_suppkey") % 60).cast("string"), F.lit(".50 avg60=1.00 avg300=0.00 total=7"))
    rows = table(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("scope"), F.lit(None).cast("timestamp").alias("ts"), text.alias("text"))
    return observations.pressure_samples(rows).select(F.col("scope").cast("long").alias("s_suppkey"), "some_avg10", "bucket")


@query("a29_disk_samples", "SELECT p_partkey, round(100.0 * p_size / 60, 4) AS free_pct, -1.0::DOUBLE AS inode_free_pct FROM part")
def disk_samples(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.lit(60).alias("blocks"), F.col("p_size").alias("free"), F.lit(0).alias("files"), F.lit(0).alias("files_free"))
    return observations.disk(rows).select("p_partkey", "free_pct", "inode_free_pct")


@query("d31_streamed_sample", f"WITH {R} SELECT seq FROM r WHERE ('0x' || substr(sha256(seq::VARCHAR), 1, 8))::BIGINT % 5 = 0")
def streamed_sample(spark, d):
    return records(spark, d).where(signature.sampled("seq", 5)).select("seq")
