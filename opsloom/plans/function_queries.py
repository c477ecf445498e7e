"""Queries of single functions over whole tables, each against the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, redact, signature, subjects, textnorm
from ..sources import envelopes
from .catalog import query, spread, table
from .stream_queries import R, records

_SIG = "'psi:sha256v1:' || substr(sha256('psi' || chr(31) || trim(n_name) || chr(31) || n_regionkey || chr(30)), 1, 16)"


# ---------------------------------------------------------------- signatures, keys, identifiers
@query("d2_clean_field", "SELECT c_custkey, trim(c_name || ' ' || c_mktsegment || '   ') AS clean FROM customer")
def clean_field(spark, d):
    return table(spark, d, "customer").select("c_custkey", signature.clean_field(F.concat(F.lit("\x1e "), F.col("c_name"), F.lit("\x1f"), F.col("c_mktsegment"), F.lit("\x00 \t"))).alias("clean"))


@query("d3_sha256", "SELECT n_nationkey, sha256(n_name) AS digest FROM nation")
def sha256(spark, d):
    return table(spark, d, "nation").select("n_nationkey", signature.digest(F.col("n_name")).alias("digest"))


@query("d4_signature_text", f"SELECT n_nationkey, {_SIG} AS sig FROM nation")
def signature_text(spark, d):
    return table(spark, d, "nation").select("n_nationkey", signature.signature("psi", "n_name", "n_regionkey").alias("sig"))


@query("d6_signature_of_fields", "SELECT s_suppkey, source || ':sha256v1:' || substr(sha256(source || chr(31) || trim(s_name) || chr(31) || chr(30)), 1, 16) AS sig FROM (SELECT *, CASE WHEN s_nationkey % 2 = 0 THEN 'disk' ELSE 'timers' END AS source FROM supplier)")
def signature_of_fields(spark, d):
    source = F.when(F.col("s_nationkey") % 2 == 0, "disk").otherwise("timers")
    return table(spark, d, "supplier").select("s_suppkey", signature.signature(source, "s_name", F.lit(None).cast("string")).alias("sig"))


@query("d7_short_digest", "SELECT p_partkey, substr(sha256(p_name), 1, 16) AS short FROM part")
def short_digest(spark, d):
    return table(spark, d, "part").select("p_partkey", signature.short(signature.digest(F.col("p_name"))).alias("short"))


@query("d28_event_ids", "SELECT event_id, event_id % 3 <> 0 AS ok FROM events")
def event_ids(spark, d):
    hexed = F.md5(F.col("event_id").cast("string").cast("binary"))
    of = F.when(F.col("event_id") % 3 == 0, F.upper(F.concat(F.lit("F"), F.substring(hexed, 1, 31)))).otherwise(hexed)
    return table(spark, d, "events").select("event_id", classify.event_id_ok(of).alias("ok"))


@query("d75_ulids", "SELECT o_orderkey, o_orderkey % 2 = 0 AS ok FROM orders")
def ulids(spark, d):
    body = F.translate(F.upper(F.substring(signature.digest(F.col("o_orderkey").cast("string")), 1, 26)), "ILOU", "1100")
    return table(spark, d, "orders").select("o_orderkey", signature.valid_ulid("inc_", F.concat(F.when(F.col("o_orderkey") % 2 == 0, "inc_").otherwise("grp_"), body)).alias("ok"))


@query("d74_minted_ids", "SELECT o_orderkey, 'evt_' || upper(substr(sha256(o_orderkey || chr(31) || o_custkey), 1, 26)) AS id FROM orders")
def minted_ids(spark, d):
    return table(spark, d, "orders").select("o_orderkey", signature.stable_id("evt_", "o_orderkey", "o_custkey").alias("id"))


@query("d83_stable_ids", "SELECT c_custkey, 'iss_' || upper(substr(sha256(c_name), 1, 26)) AS id FROM customer")
def stable_ids(spark, d):
    return table(spark, d, "customer").select("c_custkey", signature.stable_id("iss_", "c_name").alias("id"))


def addresses(spark, d):
    rows = records(spark, d)
    part = lambda c: (F.col(c) % 256).cast("string")
    return rows.select("seq", F.concat_ws(".", part("scope"), ((F.col("seq") - 1) % 256).cast("string"), part("k"), F.lit("9")).alias("ip"))


_IPS = f"WITH {R}, a AS (SELECT seq, (scope % 256) AS a, ((seq - 1) % 256) AS b, (scope % 256) || '.' || ((seq - 1) % 256) || '.' || (k % 256) || '.9' AS ip FROM r)"
_LAN = "a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254)"


@query("d79_ip_hash", f"{_IPS} SELECT seq, substr(sha256(ip), 1, 16) AS hash FROM a")
def ip_hash(spark, d):
    return addresses(spark, d).select("seq", signature.ip_hash("ip").alias("hash"))


@query("d80_ip_zone", f"{_IPS} SELECT seq, CASE WHEN a = 127 THEN 'loopback' WHEN {_LAN} THEN 'lan' ELSE 'public' END AS zone FROM a")
def ip_zone(spark, d):
    return addresses(spark, d).select("seq", classify.zone("ip").alias("zone"))


@query("d63_ip_exemption", f"{_IPS} SELECT seq, a IN (127, 0) OR {_LAN} AS exempt FROM a")
def ip_exemption(spark, d):
    return addresses(spark, d).select("seq", classify.exempt_address("ip").alias("exempt"))


@query("d64_strict_quad", f"{_IPS}, b AS (SELECT seq, CASE WHEN seq % 5 = 0 THEN ip || '.1' WHEN seq % 7 = 0 THEN '256' || substr(ip, strpos(ip, '.')) ELSE ip END AS t FROM a) SELECT seq, CASE WHEN seq % 5 = 0 OR seq % 7 = 0 THEN NULL ELSE list_sum(list_transform(string_split(t, '.'), lambda x: x::INTEGER))::BIGINT END AS total FROM b")
def strict_quad(spark, d):
    text = F.when(F.col("seq") % 5 == 0, F.concat("ip", F.lit(".1"))).when(F.col("seq") % 7 == 0, F.regexp_replace("ip", r"^\d+", "256")).otherwise(F.col("ip"))
    q = classify.quad(text)
    return addresses(spark, d).select("seq", F.when(q.isNotNull(), F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))


@query("d78_page_tokens", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id * 3 END AS token_offset, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id + 1 END AS seq FROM events")
def page_tokens(spark, d):
    e = F.col("event_id")
    text = F.when(e % 4 == 0, F.concat(F.lit("2024-01-01.g0.p0001.jsonl::x::"), e.cast("string"))).otherwise(F.concat_ws("::", F.lit("2024-01-01.g0.p0001.jsonl"), (e * 3).cast("string"), (e + 1).cast("string")))
    token = subjects.page_token(text)
    return table(spark, d, "events").select("event_id", token["offset"].alias("token_offset"), token["seq"].alias("seq"))


@query("d105_payload_verification", "SELECT event_id, event_id % 6 <> 0 AS ok FROM events")
def payload_verification(spark, d):
    """The stored hash against that of the stored bytes without it."""
    stored = F.when(F.col("event_id") % 6 == 0, F.concat("props", F.lit(" "))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", (signature.short(signature.digest(F.col("props"))) == signature.short(signature.digest(stored))).alias("ok"))


# ---------------------------------------------------------------- classes and numbers
@query("d30_release_numbers", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size::BIGINT END AS number FROM part")
def release_numbers(spark, d):
    segment = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("rc"), F.col("p_size").cast("string"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("v"), F.col("p_size").cast("string"))).otherwise(F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", classify.segment_number(segment).alias("number"))


@query("d35_missed_bucket", "SELECT p_partkey, CASE WHEN p_size - 3 <= 0 THEN '0' WHEN p_size - 3 = 1 THEN '1' WHEN p_size - 3 <= 4 THEN '2-4' WHEN p_size - 3 <= 9 THEN '5-9' ELSE '10+' END AS bucket FROM part")
def missed_bucket(spark, d):
    return table(spark, d, "part").select("p_partkey", classify.missed_bucket(F.col("p_size") - 3).alias("bucket"))


@query("d37_severity_of_priority", "SELECT p_partkey, CASE WHEN p_size % 9 <= 2 THEN 'critical' WHEN p_size % 9 = 3 THEN 'high' WHEN p_size % 9 = 4 THEN 'medium' WHEN p_size % 9 <= 6 THEN 'low' ELSE 'info' END AS severity FROM part")
def severity_of_priority(spark, d):
    return table(spark, d, "part").select("p_partkey", classify.severity_of_priority(F.col("p_size") % 9).alias("severity"))


SEVERITY = "CASE p_size % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END"


def severities(spark, d):
    return table(spark, d, "part").select("p_partkey", classify.chosen(F.col("p_size") % 5, [(0, "critical"), (1, "high"), (2, "medium"), (3, "low")], "info").alias("severity"))


@query("d39_priority_of_severity", f"SELECT p_partkey, CASE {SEVERITY} WHEN 'critical' THEN 'P0' WHEN 'high' THEN 'P1' WHEN 'medium' THEN 'P2' ELSE 'P3' END AS priority FROM part")
def priority_of_severity(spark, d):
    return severities(spark, d).select("p_partkey", classify.priority_of(F.col("severity")).alias("priority"))


@query("d40_complexity", f"SELECT p_partkey, CASE WHEN s = 'critical' THEN 'L' WHEN s IN ('high', 'medium') THEN 'M' ELSE 'S' END AS complexity FROM (SELECT p_partkey, {SEVERITY} AS s FROM part)")
def complexity(spark, d):
    return severities(spark, d).select("p_partkey", classify.complexity_of(F.col("severity")).alias("complexity"))


RUNG = "CASE p_size % 6 WHEN 0 THEN 'record' WHEN 1 THEN 'play' WHEN 2 THEN 'research' WHEN 3 THEN 'agent' WHEN 4 THEN 'outlets' ELSE 'other' END"


def rungs(spark, d):
    return table(spark, d, "part").select("p_partkey", classify.chosen(F.col("p_size") % 6, [(0, "record"), (1, "play"), (2, "research"), (3, "agent"), (4, "outlets")], "other").alias("rung"))


@query("d103_rung_rank", f"SELECT p_partkey, CASE {RUNG} WHEN 'play' THEN 1 WHEN 'research' THEN 2 WHEN 'agent' THEN 3 WHEN 'outlets' THEN 4 ELSE 0 END AS rank FROM part")
def rung_rank(spark, d):
    return rungs(spark, d).select("p_partkey", classify.rung_rank(F.col("rung")).alias("rank"))


@query("b38_rung_guard", f"SELECT p_partkey, {RUNG} IN ('research', 'agent', 'outlets') AS passes FROM part")
def rung_guard(spark, d):
    return rungs(spark, d).select("p_partkey", (classify.rung_rank(F.col("rung")) >= 2).alias("passes"))


SOURCE = "CASE s_suppkey % 6 WHEN 0 THEN 'sentinel' WHEN 1 THEN 'journald' WHEN 2 THEN 'disk' WHEN 3 THEN 'dbus' WHEN 4 THEN 'collector' ELSE 'psi' END"
_CLASS = f"CASE WHEN {SOURCE} IN ('sentinel', 'collector') THEN 'app' WHEN {SOURCE} IN ('journald', 'dbus') THEN 'unit' ELSE 'resource' END"


def sourced(spark, d):
    source = classify.chosen(F.col("s_suppkey") % 6, [(0, "sentinel"), (1, "journald"), (2, "disk"), (3, "dbus"), (4, "collector")], "psi")
    return table(spark, d, "supplier").withColumn("source", source)


@query("d100_source_class", f"SELECT s_suppkey, {_CLASS} AS class FROM supplier")
def source_class(spark, d):
    return sourced(spark, d).select("s_suppkey", classify.source_class(F.col("source")).alias("class"))


@query("b39_mutating_modules", "SELECT n_nationkey, m IN ('config.set', 'service.restart', 'service.stop', 'file.write', 'flow.append') AS mutating FROM (SELECT n_nationkey, (['config.get', 'config.list', 'config.set', 'service.status', 'service.restart', 'service.stop', 'file.read', 'file.write', 'flow.append', 'proc.list', 'x'])[n_nationkey % 11 + 1] AS m FROM nation)")
def mutating_modules(spark, d):
    names = F.array(*map(F.lit, ("config.get", "config.list", "config.set", "service.status", "service.restart", "service.stop", "file.read", "file.write", "flow.append", "proc.list", "x")))
    return table(spark, d, "nation").select("n_nationkey", subjects.is_mutating(F.element_at(names, (F.col("n_nationkey") % 11 + 1).cast("int"))).alias("mutating"))


@query("b36_canary_events", f"WITH {R} SELECT seq, kind = 'canary' OR k % 10 = 0 AS canary FROM r")
def canary_events(spark, d):
    prints = F.when(F.col("k") % 10 == 0, F.array(F.lit("x"), F.lit("canary"))).otherwise(F.array(F.lit("x")))
    return records(spark, d).select("seq", subjects.is_canary(F.col("kind"), prints).alias("canary"))


@query("b37_generic_fold", f"WITH {R} SELECT seq, source = 'click' AND k % 2 = 0 AND k % 3 <> 0 AND k % 5 <> 0 AS folds FROM r")
def generic_fold(spark, d):
    k = F.col("k")
    kind = F.when(F.col("source") == "click", "generic").otherwise("sdk")
    return records(spark, d).select("seq", subjects.generic_fold_applies(kind, k % 2 != 0, k % 3 == 0, F.when(k % 5 == 0, "spool_replay").otherwise("accepted")).alias("folds"))


@query("d98_in_app_paths", "SELECT p_partkey, p_size % 5 = 4 AS in_app FROM part")
def in_app_paths(spark, d):
    paths = F.array(*map(F.lit, ("/root/go/pkg/mod/x/y.go", "/app/vendor/z/z.go", "/usr/local/go/src/net/http/server.go", "runtime/panic.go", "/app/internal/main.go")))
    return table(spark, d, "part").select("p_partkey", classify.in_app_go(F.element_at(paths, (F.col("p_size") % 5 + 1).cast("int"))).alias("in_app"))


@query("d76_rfc3339", "SELECT event_id, ts, NULL::TIMESTAMP AS bad FROM events")
def rfc3339(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return table(spark, d, "events").select("event_id", classify.json_time(text).alias("ts"), classify.json_time(F.lit("2024-13-01T00:00:00Z")).alias("bad"))


@query("d23_epoch_or_text", "SELECT event_id, ts FROM events")
def epoch_or_text(spark, d):
    number = (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(20,6)").cast("string")
    text = F.when(F.col("event_id") % 2 == 0, number).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return table(spark, d, "events").select("event_id", classify.json_time(text).alias("ts"))


@query("d99_report_times", "SELECT event_id, date_trunc('second', ts) AS reported FROM events")
def report_times(spark, d):
    text = F.when(F.col("event_id") % 2 == 0, F.unix_timestamp("ts").cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, d, "events").select("event_id", classify.json_time(text).alias("reported"))


@query("d77_durations", "SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN 0 ELSE p_size % 4 * 3600 + p_size * 60 + 0.25 END::DOUBLE AS seconds FROM part")
def durations(spark, d):
    n = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 4 == 3, F.concat(n, F.lit("x"))).otherwise(F.concat((F.col("p_size") % 4).cast("string"), F.lit("h"), n, F.lit("m250ms")))
    return table(spark, d, "part").select("p_partkey", classify.duration_seconds(text).alias("seconds"))


@query("d86_timer_arithmetic", "SELECT o_orderkey, epoch(TIMESTAMP '1998-12-01' - o_orderdate::TIMESTAMP)::BIGINT AS since, greatest(epoch(o_orderdate::TIMESTAMP + INTERVAL 30 DAY - TIMESTAMP '1998-01-01'), 0)::BIGINT AS until FROM orders")
def timer_arithmetic(spark, d):
    at = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    of = lambda text: F.unix_timestamp(F.lit(text).cast("timestamp"))
    return table(spark, d, "orders").select("o_orderkey", (of("1998-12-01") - at).alias("since"), F.greatest(at + 30 * 86400 - of("1998-01-01"), F.lit(0).cast("long")).alias("until"))


# ---------------------------------------------------------------- subjects, titles, slugs
_RAW = "CASE p_size % 5 WHEN 0 THEN 'web@' || p_size || '-7.service' WHEN 1 THEN 'deadbeef0000' WHEN 2 THEN '  Pay Worker.TIMER ' WHEN 3 THEN '' ELSE 'x_y--' || p_size END"
_KEBAB = "CASE p_size % 5 WHEN 0 THEN 'web' WHEN 1 THEN 'container' WHEN 2 THEN 'pay-worker' WHEN 3 THEN '' ELSE 'x-y-' || p_size END"


def raw_subject():
    n = F.col("p_size").cast("string")
    r = F.col("p_size") % 5
    return F.when(r == 0, F.concat(F.lit("web@"), n, F.lit("-7.service"))).when(r == 1, "deadbeef0000").when(r == 2, "  Pay Worker.TIMER ").when(r == 3, "").otherwise(F.concat(F.lit("x_y--"), n))


@query("d104_kebab_subject", f"SELECT p_partkey, {_KEBAB} AS subject FROM part")
def kebab_subject(spark, d):
    return table(spark, d, "part").select("p_partkey", subjects.kebab_subject(raw_subject(), F.lit("")).alias("subject"))


@query("d49_instances", "SELECT p_partkey, 'web@' || CASE WHEN p_size % 2 = 0 THEN 'a' ELSE '' END AS unit FROM part")
def instances(spark, d):
    name = F.concat(F.lit("web@"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.concat(F.col("p_size").cast("string"), F.lit("-1.2"))), F.when(F.col("p_size") % 2 == 0, "a").otherwise(""))
    return table(spark, d, "part").select("p_partkey", classify.collapse_instance(name).alias("unit"))


@query("d45_slugs", f"SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'listed-one' WHEN {_KEBAB} <> '' THEN {_KEBAB} || '-' || t ELSE CASE WHEN t = 'error' THEN 'unknown' ELSE t END END AS slug FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN 'error' ELSE 'crash-loop' END AS t FROM part)")
def slugs(spark, d):
    taxonomy = F.when(F.col("p_size") % 2 == 0, "error").otherwise("crash_loop")
    listed = F.when(F.col("p_size") % 7 == 0, "Listed One")
    return table(spark, d, "part").select("p_partkey", subjects.slug(F.lit("journald"), subjects.kebab_subject(raw_subject(), F.lit("")), taxonomy, listed).alias("slug"))


@query("d46_subject_of_source", f"SELECT s_suppkey, CASE {SOURCE} WHEN 'sentinel' THEN 'shop' WHEN 'journald' THEN 'unit' || s_suppkey WHEN 'disk' THEN '/var' WHEN 'dbus' THEN 'a-b.service' WHEN 'collector' THEN 'origin' || s_suppkey ELSE 'system' END AS subject FROM supplier")
def subject_of_source(spark, d):
    n = F.col("s_suppkey").cast("string")
    facts = {"unit": F.concat(F.lit("unit"), n), "object_path": F.lit("/org/freedesktop/systemd1/unit/a_2db_2eservice"), "project": F.lit("shop"), "app": F.lit(""), "mount": F.lit("/var"), "path": F.lit("/a/b/"), "scope": F.lit("system")}
    return sourced(spark, d).select("s_suppkey", subjects.subject(F.col("source"), facts, F.concat(F.lit("any:origin"), n)).alias("subject"))


@query("d50_app_kinds", f"SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'given' WHEN s_suppkey % 4 = 1 THEN 'container' WHEN {SOURCE} IN ('journald', 'dbus') THEN 'unit' WHEN {SOURCE} = 'collector' THEN 'script' ELSE 'unknown' END AS kind FROM supplier")
def app_kinds(spark, d):
    r = F.col("s_suppkey") % 4
    kind = subjects.app_kind(F.when(r == 0, "given").otherwise(""), F.when(r == 1, "host:Docker-7").otherwise("host:x"), F.lit(""), F.col("source"))
    return sourced(spark, d).select("s_suppkey", kind.alias("kind"))


@query("d42_classifier_text", "SELECT n_nationkey, n_name || chr(10) || 'first frame' || chr(10) || 'psi:x' AS text FROM nation")
def classifier_text(spark, d):
    return table(spark, d, "nation").select("n_nationkey", subjects.facts_text(F.col("n_name"), F.lit("\n  \n first frame \nsecond"), F.lit("psi:x")).alias("text"))


@query("d101_incident_subjects", f"SELECT s_suppkey, CASE {_CLASS} WHEN 'unit' THEN s_name WHEN 'app' THEN CASE WHEN s_suppkey % 4 = 0 THEN 'unit:web' ELSE 'project:' || s_name END ELSE s_name || ' ' END AS subject FROM supplier")
def incident_subjects(spark, d):
    raw = F.when((F.col("s_suppkey") % 4 == 0) & F.col("source").isin("sentinel", "collector"), "shop").when(F.col("source").isin("sentinel", "collector"), F.col("s_name")).otherwise(F.concat("s_name", F.lit(" ")))
    return sourced(spark, d).select("s_suppkey", subjects.merge_subject_of(F.col("source"), raw, F.create_map(F.lit("shop"), F.lit("web"))).alias("subject"))


@query("d102_subject_lines", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN n_name || ': down' WHEN 1 THEN n_name WHEN 2 THEN 'down' ELSE '' END AS line FROM nation")
def subject_lines(spark, d):
    r = F.col("n_nationkey") % 4
    return table(spark, d, "nation").select("n_nationkey", subjects.subject_line(F.when(r.isin(0, 1), F.concat(F.lit(" "), "n_name")).otherwise(""), F.when(r.isin(0, 2), "down").otherwise("")).alias("line"))


@query("d96_group_titles", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'culprit ' || n_name WHEN 1 THEN left(repeat('m', 300), 200) WHEN 2 THEN 'ValueError' ELSE 'fatal event' END AS title FROM nation")
def group_titles(spark, d):
    r = F.col("n_nationkey") % 4
    return table(spark, d, "nation").select("n_nationkey", subjects.title(F.when(r == 0, F.concat(F.lit("culprit "), "n_name")).otherwise(""), F.when(r == 1, F.repeat(F.lit("m"), 300)).otherwise(""), F.when(r <= 2, "ValueError").otherwise(""), F.lit("fatal")).alias("title"))


@query("d111_scalar_texts", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a b' WHEN 1 THEN event_id::VARCHAR WHEN 2 THEN 'true' ELSE '' END AS text FROM events")
def scalar_texts(spark, d):
    e = F.col("event_id")
    json = F.when(e % 4 == 0, F.lit('{"x":"a b"}')).when(e % 4 == 1, F.concat(F.lit('{"x":'), e.cast("string"), F.lit("}"))).when(e % 4 == 2, F.lit('{"x":true}')).otherwise(F.lit('{"x":null}'))
    return table(spark, d, "events").select("event_id", subjects.scalar_text(json, "$.x").alias("text"))


@query("d73_nested_lookup", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'v' || event_id END AS value FROM events")
def nested_lookup(spark, d):
    json = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.struct(F.struct(F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("ua")).alias("headers")).alias("request")))).otherwise(F.lit('{"request":{"headers":7}}'))
    return table(spark, d, "events").select("event_id", F.get_json_object(json, "$.request.headers.ua").alias("value"))


@query("d109_canonical_json", "SELECT n_nationkey, '{\"name\":\"' || n_name || '\",\"sigs\":[\"a\",\"b\"],\"version\":\"1.' || n_regionkey || '\"}' AS json FROM nation")
def canonical_json(spark, d):
    """Members in the order of their names, lists sorted, no blanks."""
    fields = F.struct(F.concat(F.lit("1."), F.col("n_regionkey").cast("string")).alias("version"), F.array(F.lit("b"), F.lit("a")).alias("sigs"), F.col("n_name").alias("name"))
    return table(spark, d, "nation").select("n_nationkey", signature.canonical_json(fields, ("name", "sigs", "version"), ("sigs",)).alias("json"))


@query("d110_sorted_tags", "SELECT event_id, 'a=1,b=' || event_type || ',z=' || user_id AS tags FROM events")
def sorted_tags(spark, d):
    tags = F.create_map(F.lit("z"), F.col("user_id").cast("string"), F.lit("b"), F.col("event_type"), F.lit("a"), F.lit("1"))
    return table(spark, d, "events").select("event_id", F.array_join(envelopes.sorted_tags(tags), ",").alias("tags"))


@query("d26_tag_forms", "SELECT event_id, event_type AS kind FROM events")
def tag_forms(spark, d):
    pair = F.array(F.struct(F.lit("kind").alias("key"), F.col("event_type").alias("value")))
    json = F.when(F.col("event_id") % 2 == 0, F.to_json(pair)).otherwise(F.to_json(F.struct(F.col("event_type").alias("kind"))))
    return table(spark, d, "events").select("event_id", F.try_element_at(envelopes.tags(json), F.lit("kind")).alias("kind"))


# ---------------------------------------------------------------- masks, frames, terms
def _masked(column: str, masks) -> str:
    import re as _re

    for pattern, by in masks:
        column = f"regexp_replace({column}, '{pattern}', '{_re.sub(r'[$](\d)', r'\\\\\\1', by)}', 'g')"
    return column


_WS = r"[\t\n\f\r ]+"
#: The masks of an error line for texts without paths, durations and temporary files.
LINE_SQL = _masked(
    "l",
    [("[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "UUID"), (r":(?:6[0-9]{4}|[1-9][0-9]{3,4})\b", ":PORT"), ("0x[0-9a-fA-F]{4,}", "0xADDR"), (r"\b[0-9a-f]{8,}\b", "HEXID"), (r"\b\d{3,}\b", "N"), (_WS, " ")],
)


def error_line(n):
    return F.concat(F.lit("dial 10.0.0.1:"), (n % 60000 + 2000).cast("string"), F.lit(" failed at 0x7ffeabcd code "), n.cast("string"), F.lit("  id "), F.md5(n.cast("string").cast("binary")))


_LINE = "'dial 10.0.0.1:' || (o_orderkey % 60000 + 2000) || ' failed at 0x7ffeabcd code ' || o_orderkey || '  id ' || md5(o_orderkey::VARCHAR)"


@query("d12_error_lines", f"SELECT o_orderkey, {LINE_SQL} AS masked FROM (SELECT o_orderkey, {_LINE} AS l FROM orders)")
def error_lines(spark, d):
    return table(spark, d, "orders").select("o_orderkey", textnorm.mask_line(error_line(F.col("o_orderkey"))).alias("masked"))


@query("d13_error_texts", f"SELECT o_orderkey, {LINE_SQL} || chr(10) || 'and N' AS masked FROM (SELECT o_orderkey, {_LINE} AS l FROM orders)")
def error_texts(spark, d):
    return table(spark, d, "orders").select("o_orderkey", textnorm.mask_text(F.concat(F.lit("  "), error_line(F.col("o_orderkey")), F.lit(" \r\n  and 1234\r"))).alias("masked"))


@query("d14_context_lines", f"SELECT o_orderkey, {LINE_SQL} AS masked FROM (SELECT o_orderkey, {_LINE} AS l FROM orders)")
def context_lines(spark, d):
    return table(spark, d, "orders").select("o_orderkey", textnorm.mask_context(F.concat(F.lit("\t"), error_line(F.col("o_orderkey")), F.lit("\nmore"))).alias("masked"))


@query("d95_module_names", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'given' ELSE 'worker' END AS module FROM part")
def module_names(spark, d):
    return table(spark, d, "part").select("p_partkey", textnorm.module_of(F.when(F.col("p_size") % 2 == 0, "given").otherwise(""), F.lit("/srv/app/worker.py")).alias("module"))


def frames(n):
    """Frames 1 to n, the even ones of the application."""
    i = F.sequence(F.lit(1), n)
    return F.transform(i, lambda k: F.struct(F.concat(F.lit("/app/f"), k.cast("string"), F.lit(".py")).alias("filename"), F.concat(F.lit("run"), k.cast("string")).alias("function"), F.lit("").alias("module"), k.alias("lineno"), (k % 2 == 0).alias("in_app"), F.lit(" x = 1 ").alias("context_line")))


_FRAME = "CASE WHEN i % 2 = 0 THEN 'app' ELSE 'lib' END || '|f' || i || '|run' || i || '|f' || i || '.py|LINE|x = 1'"


@query("d16_frame_lines", f"SELECT p_partkey, {_FRAME} AS line FROM (SELECT p_partkey, p_size AS i FROM part)")
def frame_lines(spark, d):
    return table(spark, d, "part").select("p_partkey", textnorm.frame_line(F.element_at(frames(F.col("p_size")), -1)).alias("line"))


_STACK = f"array_to_string(list_transform(range(1, least(p_size, 8) + 1), lambda i: {_FRAME}), chr(10)) || CASE WHEN p_size > 8 THEN chr(10) || 'frames_over=+' || (p_size - 8) ELSE '' END"


@query("d17_capped_frames", "SELECT p_partkey, least(p_size, 8) + CASE WHEN p_size > 8 THEN 1 ELSE 0 END AS lines, CASE WHEN p_size > 8 THEN 'frames_over=+' || (p_size - 8) END AS over FROM part")
def capped_frames(spark, d):
    lines = textnorm.frame_lines(frames(F.col("p_size")))
    last = F.element_at(lines, -1)
    return table(spark, d, "part").select("p_partkey", F.size(lines).alias("lines"), F.when(F.startswith(last, F.lit("frames_over")), last).alias("over"))


@query("d18_stack_texts", f"SELECT p_partkey, {_STACK} AS stack FROM part")
def stack_texts(spark, d):
    return table(spark, d, "part").select("p_partkey", textnorm.stack_text(textnorm.frame_lines(frames(F.col("p_size")))).alias("stack"))


@query("d93_frames_of_lines", "SELECT p_partkey, p_size % 2 = 0 AS in_app, 'f' || p_size AS module, 'run' || p_size AS function, 'f' || p_size || '.py' AS filename FROM part")
def frames_of_lines(spark, d):
    f = textnorm.frame_of_line(textnorm.frame_line(F.element_at(frames(F.col("p_size")), -1)))
    return table(spark, d, "part").select("p_partkey", *(f[c].alias(c) for c in ("in_app", "module", "function", "filename")))


@query("d89_stack_round_trip", "SELECT p_partkey, least(p_size, 8) AS frames, true AS same FROM part")
def stack_round_trip(spark, d):
    """Rendered, parsed and rendered again: the lines stay the same."""
    lines = F.slice(textnorm.frame_lines(frames(F.col("p_size"))), 1, F.least(F.col("p_size"), F.lit(8)))
    # a column for each step: written into one expression, every step would run again for each use of it
    rows = spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", lines.alias("lines"))
    rows = rows.withColumn("parsed", F.transform(F.split(textnorm.stack_text(F.col("lines")), "\n", -1), textnorm.frame_of_line))
    again = F.transform("parsed", lambda f: F.concat_ws("|", F.when(f["in_app"], "app").otherwise("lib"), f["module"], f["function"], f["filename"], F.lit("LINE"), f["context_line"]))
    return rows.select("p_partkey", F.size("parsed").alias("frames"), (again == F.col("lines")).alias("same"))


@query("d20_fingerprints", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN 'mine' || chr(10) || 'x-dflt-y' ELSE 'only' END AS fingerprint FROM part")
def fingerprints(spark, d):
    r = F.col("p_size") % 3
    parts = F.when(r == 0, F.array(F.lit(" "), F.lit(""))).when(r == 1, F.array(F.lit("mine"), F.lit("x-{{ default }}-y"))).otherwise(F.array(F.lit(" only ")))
    return table(spark, d, "part").select("p_partkey", textnorm.fingerprint(parts, F.lit("dflt")).alias("fingerprint"))


@query("d52_term_counts", "SELECT conv_id, turn, (contains(lower(text), 'the') :: INTEGER + contains(lower(text), 'please')::INTEGER + contains(lower(text), 'ing')::INTEGER)::INTEGER AS terms FROM conversations")
def term_counts(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", textnorm.count_terms(F.col("text"), F.array(F.lit("the"), F.lit("please"), F.lit("ing"))).alias("terms"))


@query("d53_frame_symbols", "SELECT p_partkey, 'work' || p_size AS symbol FROM part")
def frame_symbols(spark, d):
    return table(spark, d, "part").select("p_partkey", textnorm.frame_symbol(F.concat(F.lit("main.(*T).work"), F.col("p_size").cast("string"), F.lit("(0x1, 0x2)"))).alias("symbol"))


@query("d90_chunks", "SELECT p_partkey, CASE WHEN p_size > 30 THEN '0,1,2,2' WHEN p_size > 20 THEN '0,0,1,1' ELSE '0,0,0,1' END AS groups FROM part")
def chunk_groups(spark, d):
    lengths = F.when(F.col("p_size") > 30, F.array(F.lit(30), F.col("p_size"), F.lit(30), F.lit(20))).when(F.col("p_size") > 20, F.array(F.lit(30), F.col("p_size"), F.lit(35), F.lit(20))).otherwise(F.array(F.lit(30), F.col("p_size"), F.lit(10), F.lit(20)))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(textnorm.chunks(lengths, 60), lambda g: g.cast("string")), ",").alias("groups"))


# ---------------------------------------------------------------- redaction of built texts
def _redacted(spark, d, text):
    return redact.scrub(table(spark, d, "orders").select("o_orderkey", text.alias("text")), "text").select("o_orderkey", "text", "redactions")


def _n():
    return F.col("o_orderkey").cast("string")


@query("d57_ordered_rules", "SELECT o_orderkey, 'PASSWORD=[REDACTED:env_assign] then user: [REDACTED:pii_identity_kv]' AS text, 2 AS redactions FROM orders")
def ordered_rules(spark, d):
    return _redacted(spark, d, F.concat(F.lit("PASSWORD=p"), _n(), F.lit(" then user: u"), _n()))


@query("d58_group_spans", "SELECT o_orderkey, 'postgres://app' || o_orderkey || ':[REDACTED:conn_string_password]@db/x [REDACTED:env_assign] ok' AS text, 1 AS redactions FROM orders")
def group_spans(spark, d):
    return _redacted(spark, d, F.concat(F.lit("postgres://app"), _n(), F.lit(":s3c@db/x [REDACTED:env_assign] ok")))


@query("d59_long_values", "SELECT o_orderkey, 'token=[REDACTED:env_assign] end' AS text, 1 AS redactions FROM orders")
def long_values(spark, d):
    """Values of thousands of characters go whole."""
    keys = spread(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    return redact.scrub(keys.select("o_orderkey", F.concat(F.lit("token="), F.repeat(_n(), 3000), F.lit(" end")).alias("text")), "text").select("o_orderkey", "text", "redactions")


@query("d60_key_blocks", "SELECT o_orderkey, 'a ' || o_orderkey || chr(10) || '[REDACTED:private_key_block]' || chr(10) || 'b' AS text, 1 AS redactions FROM orders")
def key_blocks(spark, d):
    return _redacted(spark, d, F.concat(F.lit("a "), _n(), F.lit("\n-----BEGIN RSA PRIVATE KEY-----\nMII"), _n(), F.lit("\nAB\n-----END RSA PRIVATE KEY-----\nb")))


_HEX = "md5(o_orderkey::VARCHAR)"


def _md5():
    return F.md5(_n().cast("binary"))


@query("d61_dsn_secrets", f"SELECT o_orderkey, 'https://' || {_HEX} || ':[REDACTED:dsn_secret]@errors/42' AS text, 1 AS redactions FROM orders")
def dsn_secrets(spark, d):
    return _redacted(spark, d, F.concat(F.lit("https://"), _md5(), F.lit(":"), _md5(), F.lit("@errors/42")))


@query("d62_dsn_forms", f"SELECT o_orderkey, 'see https://' || {_HEX} || '@errors:90/' || o_orderkey || ' now' AS text, 1 AS redactions FROM orders")
def dsn_forms(spark, d):
    return _redacted(spark, d, F.concat(F.lit("see https://"), _md5(), F.lit("@errors:90/"), _n(), F.lit("/api/x?y=1 now")))


@query("d65_home_roots", "SELECT o_orderkey, 'open [REDACTED:path_home_root]/x' || o_orderkey || ' and /srv/src/y' AS text, 1 AS redactions FROM orders")
def home_roots(spark, d):
    return _redacted(spark, d, F.concat(F.lit("open /home/u"), _n(), F.lit("/x"), _n(), F.lit(" and /srv/src/y")))


@query("d66_path_flags", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'run --token ./t' || o_orderkey || '.json' ELSE 'run --token [REDACTED:cli_flag_secret]' END AS text, (o_orderkey % 2)::INTEGER AS redactions FROM orders")
def path_flags(spark, d):
    return _redacted(spark, d, F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("run --token ./t"), _n(), F.lit(".json"))).otherwise(F.concat(F.lit("run --token t"), _n())))


@query("d55_entropy_tokens", "SELECT o_orderkey, 'id [REDACTED:entropy_token] of ' || sha256(o_orderkey::VARCHAR) AS text, 1 AS redactions FROM orders")
def entropy_tokens(spark, d):
    return _redacted(spark, d, F.concat(F.lit("id Zx8Kq2Wm5Rt9Yv3Lp7Nc1Bd6Fh4Gj0Sa5De2Ui"), _n(), F.lit("Q3w of "), signature.digest(_n())))


@query("d67_prefilter", "SELECT o_orderkey, 'nothing to see in order ' || o_orderkey AS text, 0 AS redactions FROM orders")
def prefilter(spark, d):
    return _redacted(spark, d, F.concat(F.lit("nothing to see in order "), _n()))


@query("d68_public_keys", f"SELECT o_orderkey, 'key={'ab' * 16} password=[REDACTED:env_assign]' AS text FROM orders")
def public_keys(spark, d):
    text = F.concat(F.lit(f"key={'ab' * 16} password=p"), _n())
    r = redact.redacted(text, settings=redact.Settings(public_keys=("ab" * 16,)))
    from ..shipping import ship

    ship(spark)
    return table(spark, d, "orders").select("o_orderkey", r.alias("r")).select("o_orderkey", "r.text")


@query("d69_fields", "SELECT o_orderkey, 'password=[REDACTED:env_assign]' AS a, 'password=kept' AS b, 'mia@example.org' AS h, 1 AS redactions FROM orders")
def fields(spark, d):
    from ..shipping import ship

    ship(spark)
    held = F.create_map(F.lit("a"), F.concat(F.lit("password=p"), _n()), F.lit("b"), F.lit("password=kept"), F.lit("h"), F.lit("mia@example.org"))
    rows = table(spark, d, "orders").select("o_orderkey", redact.redacted_fields(held, {"a": "message", "h": "header"}).alias("r"))
    return rows.select("o_orderkey", *(F.col("r.fields")[c].alias(c) for c in "abh"), "r.redactions")


@query("d70_records", "SELECT o_orderkey, 'https://u:[REDACTED:url_basic_auth]@h/' || o_orderkey AS url, 1 AS n, 1 AS redactions FROM orders")
def record_paths(spark, d):
    from ..shipping import ship

    ship(spark)
    payload = F.to_json(F.struct(F.struct(F.concat(F.lit("https://u:pw@h/"), _n()).alias("url")).alias("request"), F.lit("password=kept").alias("other")))
    rows = table(spark, d, "orders").select("o_orderkey", redact.redacted_record(payload, {"request.url": "message", "request.none": "message"}).alias("r"))
    return rows.select("o_orderkey", F.get_json_object("r.text", "$.request.url").alias("url"), F.get_json_object("r.text", "$.scrub.by_rule.url_basic_auth").cast("int").alias("n"), "r.redactions")


@query("d72_byte_budget", "SELECT o_orderkey, 'first ' || o_orderkey || chr(10) || '[SCRUB-TRUNCATED:50]' AS text FROM orders")
def byte_budget(spark, d):
    from ..shipping import ship

    ship(spark)
    text = F.concat(F.lit("first "), _n(), F.lit("\n"), F.repeat(F.lit("x"), 50))
    return table(spark, d, "orders").select("o_orderkey", redact.redacted(text, budget=40).alias("r")).select("o_orderkey", "r.text")


@query("i5_project_rules", "SELECT o_orderkey, 'badge [REDACTED:badge_number] ok' AS text, 1 AS redactions FROM orders")
def project_rules(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("badge B#"), _n(), F.lit(" ok")).alias("text"))
    return redact.scrub(rows, "text", [("badge_number", r"B#\d+")]).select("o_orderkey", "text", "redactions")


@query("b35_markers", "SELECT o_orderkey, o_orderkey % 3 <> 0 AS marker FROM orders")
def markers(spark, d):
    r = F.col("o_orderkey") % 3
    text = F.when(r == 0, F.concat(F.lit("[REDACTED]"), _n())).when(r == 1, "[REDACTED:env_assign]").otherwise('"[REDACTED:jwt]"')
    return table(spark, d, "orders").select("o_orderkey", redact.is_marker(text).alias("marker"))
