"""Queries over texts and dimension tables: normalisation, identifiers, classes, decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, redact, signature, textnorm
from . import fold_sql
from .catalog import query, table

#: The masks in SQL, over a column.
_TS = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def _sql_masks(column: str, masks: list[tuple[str, str]]) -> str:
    for pattern, by in masks:
        column = f"regexp_replace({column}, '{pattern}', '{by}', 'g')"
    return column


LINE = _sql_masks("l", [(r"\b0x[0-9a-fA-F]+\b", "<hex>"), (_UUID, "<uuid>"), ("[0-9a-fA-F]{8,}", "<h>"), ("[0-9]+", "#"), (r"[\t\n\f\r ]+", " ")])
NORM = f"array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13)) <> '')[1:3], lambda l: trim({LINE})), chr(10))"


#: A byte budget in SQL: as many characters as fit.
CUT = "CASE WHEN octet_length(encode(norm)) <= 512 THEN norm ELSE left(norm, list_max(list_filter(range(0, 513), lambda n: octet_length(encode(left(norm, n))) <= 512))::BIGINT) END"


@query("d10_message_norm", f"SELECT doc_id, {CUT} AS norm FROM (SELECT doc_id, coalesce({NORM}, '') AS norm FROM documents)")
def message_norm(spark, d):
    return table(spark, d, "documents").select("doc_id", textnorm.message_norm("text").alias("norm"))


DISPLAY = _sql_masks("text", [(_TS, "<ts>"), (r"\b\d{6,}\b", "<n>"), (r"(?i)\b(?:pid|tid|thread)[ =:]+(\d+)\b", "pid=<n>"), (r"(?i)\b(?:port|listen)[ =:]+(\d+)\b", "port=<n>"), (_UUID, "<uuid>"), ("[0-9a-fA-F]{8,}", "<h>"), (r"/(?:[A-Za-z0-9._-]*/)*([A-Za-z0-9._-]+)/*", r"\1"), ("/home/[A-Za-z0-9_.-]+", "/home/<user>"), (r"[\t\n\f\r ]+", " ")])


@query("d11_display_mask", f"SELECT turn, conv_id, trim({DISPLAY}) AS masked FROM conversations")
def display_mask(spark, d):
    return table(spark, d, "conversations").select("turn", "conv_id", textnorm.mask_message("text").alias("masked"))


@query("d1_signature", "SELECT c_custkey, 'sentinel:sha256v1:' || substr(sha256('sentinel' || chr(31) || trim(c_name) || chr(31) || trim(c_mktsegment) || chr(31) || (c_custkey % 3) || chr(30)), 1, 16) AS sig FROM customer")
def signatures(spark, d):
    return table(spark, d, "customer").select("c_custkey", signature.signature("sentinel", "c_name", "c_mktsegment", F.col("c_custkey") % 3).alias("sig"))


@query("d5_parse_signature", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'psi' END AS source FROM customer")
def parse_signature(spark, d):
    sig = F.when(F.col("c_custkey") % 2 == 0, signature.signature("psi", "c_name")).otherwise(F.concat(F.lit("nope:sha256v1:"), F.col("c_name")))
    return table(spark, d, "customer").select("c_custkey", signature.parsed(sig)["source"].alias("source"))


@query("d8_merge_key", "SELECT n_nationkey, substr(sha256('merge.v1' || chr(31) || n_name || chr(31) || n_regionkey || chr(30)), 1, 16) AS key FROM nation")
def merge_key(spark, d):
    return table(spark, d, "nation").select("n_nationkey", signature.merge_key("n_name", F.col("n_regionkey")).alias("key"))


@query("d9_correlation_key", "SELECT n_nationkey, 'ink_' || substr(sha256(n_name || chr(31) || n_regionkey || chr(31) || 'error' || chr(31) || 'app'), 1, 16) AS key FROM nation")
def correlation_key(spark, d):
    return table(spark, d, "nation").select("n_nationkey", signature.correlation_key("n_name", F.col("n_regionkey"), F.lit("error"), F.lit("app")).alias("key"))


@query("d31_sampler", "SELECT o_orderkey FROM orders WHERE ('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT % 7 = 0")
def sampler(spark, d):
    return table(spark, d, "orders").where(signature.sampled("o_orderkey", 7)).select("o_orderkey")


@query("d32_buckets", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'b1' WHEN p_size < 25 THEN 'b2' WHEN p_size < 50 THEN 'b3' ELSE 'b4' END AS pressure, CASE WHEN p_size - 2 <= 0 THEN '0' WHEN p_size - 2 = 1 THEN '1' WHEN p_size - 2 <= 4 THEN '2-4' WHEN p_size - 2 <= 9 THEN '5-9' ELSE '10+' END AS missed FROM part")
def buckets(spark, d):
    return table(spark, d, "part").select("p_partkey", classify.pressure_bucket(F.col("p_size")).alias("pressure"), classify.missed_bucket(F.col("p_size") - 2).alias("missed"))


@query("d33_merge_class", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN CASE l_linestatus WHEN 'F' THEN 'crash_loop' ELSE 'unit_degraded' END WHEN 'R' THEN 'disk_full' ELSE 'resource_exhaustion' END AS class FROM lineitem")
def merge_class(spark, d):
    source = classify.chosen(F.col("l_returnflag"), [("A", "dbus"), ("R", "disk")], "psi")
    state = F.when(F.col("l_linestatus") == "F", "failed").otherwise("active")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", classify.merge_class(source, state).alias("class"))


@query("d36_priorities", "SELECT p_partkey, list_value('emerg', 'alert', 'crit', 'err', 'warning', 'notice', 'info', 'debug')[least(p % 9, 7) + 1] AS name, CASE WHEN p % 9 <= 2 THEN 'critical' WHEN p % 9 = 3 THEN 'high' WHEN p % 9 = 4 THEN 'medium' WHEN p % 9 <= 6 THEN 'low' ELSE 'info' END AS severity FROM (SELECT p_partkey, p_size AS p FROM part)")
def priorities(spark, d):
    p = F.col("p_size") % 9
    return table(spark, d, "part").select("p_partkey", classify.priority_name(p).alias("name"), classify.severity_of_priority(p).alias("severity"))


@query("d38_severity_maps", "SELECT o_orderkey, CASE s WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 9 END AS rank, CASE s WHEN 'critical' THEN 'P0' WHEN 'high' THEN 'P1' WHEN 'medium' THEN 'P2' ELSE 'P3' END AS priority, CASE s WHEN 'critical' THEN 'L' WHEN 'high' THEN 'M' WHEN 'medium' THEN 'M' ELSE 'S' END AS complexity FROM (SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE 'none' END AS s FROM orders)")
def severity_maps(spark, d):
    s = classify.chosen(F.substring("o_orderpriority", 1, 1), [("1", "critical"), ("2", "high"), ("3", "medium"), ("4", "low")], "none")
    return table(spark, d, "orders").select("o_orderkey", classify.severity_rank(s).alias("rank"), classify.priority_of(s).alias("priority"), classify.complexity_of(s).alias("complexity"))


TAX = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in classify.TAXONOMY)


@query("d41_taxonomy", f"SELECT conv_id, turn, CASE {TAX} ELSE 'error' END AS class FROM conversations")
def taxonomy(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", signature.taxonomy_of(F.col("text"), classify.TAXONOMY).alias("class"))


@query("d43_kebab", "SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || ' ' || p_type)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def kebab(spark, d):
    return table(spark, d, "part").select("p_partkey", textnorm.kebab(F.concat_ws(" ", "p_name", "p_type")).alias("slug"))


@query("d44_cut_at_dash", "SELECT p_partkey, CASE WHEN length(s) <= 12 THEN s ELSE coalesce(nullif(regexp_extract(substr(s, 1, 12), '^(.+)-[^-]*$', 1), ''), regexp_replace(substr(s, 1, 12), '-+$', '')) END AS slug FROM (SELECT p_partkey, replace(lower(p_type), ' ', '-') AS s FROM part)")
def cut_at_dash(spark, d):
    return table(spark, d, "part").select("p_partkey", textnorm.cut_at_dash(F.replace(F.lower("p_type"), F.lit(" "), F.lit("-")), 12).alias("slug"))


@query("d15_base_names", "SELECT page_id, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1) AS base FROM pages")
def base_names(spark, d):
    return table(spark, d, "pages").select("page_id", textnorm.base_name("url").alias("base"))


@query("d64_quads", "SELECT event_id, a < 256 AND b < 256 AS valid, coalesce(a < 256 AND b < 256 AND (a IN (127, 10, 0) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254)), false) AS exempt FROM (SELECT event_id, (event_id * 7 % 300)::INTEGER AS a, (event_id * 11 % 260)::INTEGER AS b FROM events)")
def quads(spark, d):
    ip = F.concat_ws(".", (F.col("event_id") * 7 % 300).cast("string"), (F.col("event_id") * 11 % 260).cast("string"), F.lit("1"), F.lit("2"))
    return table(spark, d, "events").select("event_id", classify.quad(ip).isNotNull().alias("valid"), classify.exempt_address(ip).alias("exempt"))


@query("d54_entropy", "SELECT n_nationkey, round(-sum(p * log2(p)), 9) AS bits FROM (SELECT n_nationkey, count(*) / max(length(n_name)) AS p FROM (SELECT n_nationkey, n_name, unnest(string_split(n_name, '')) AS ch FROM nation) GROUP BY n_nationkey, ch) GROUP BY 1")
def entropy(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.round(textnorm.entropy(F.col("n_name")), 9).alias("bits"))


@query("d29_release_order", "SELECT a.s_suppkey, sign(a.s_suppkey % 11 - b.s_suppkey % 11)::INTEGER AS c FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1")
def release_order(spark, d):
    a = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("v1."), (F.col("s_suppkey") % 11).cast("string")).alias("x"))
    b = a.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.regexp_replace("x", "v", "").alias("y"))
    return a.join(b, "s_suppkey").select("s_suppkey", classify.compare_releases("x", "y").alias("c"))


@query("d81_semver", "SELECT s_suppkey, (s_suppkey % 3)::INTEGER AS major, (s_suppkey % 7)::INTEGER AS minor FROM supplier WHERE s_suppkey % 4 <> 0")
def semver(spark, d):
    text = F.when(F.col("s_suppkey") % 4 != 0, F.concat_ws(".", (F.col("s_suppkey") % 3).cast("string"), (F.col("s_suppkey") % 7).cast("string"), F.lit("0"))).otherwise("none")
    out = table(spark, d, "supplier").select("s_suppkey", classify.semver(text).alias("v")).where("v is not null")
    return out.select("s_suppkey", "v.major", "v.minor")


@query("d84_edit_distance", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, levenshtein(a.n_name, b.n_name)::INTEGER AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def edit_distance(spark, d):
    n = table(spark, d, "nation")
    a, b = n.select("n_regionkey", F.col("n_nationkey").alias("a"), F.col("n_name").alias("x")), n.select("n_regionkey", F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"))
    return a.join(b, "n_regionkey").where("a < b").select("a", "b", F.levenshtein("x", "y").alias("d"))


@query("d87_content_key", "SELECT event_id, 'content:sha256v1:' || substr(sha256('content.v1' || chr(31) || event_type || chr(31) || props || chr(30)), 1, 16) AS key FROM events")
def content_key(spark, d):
    return table(spark, d, "events").select("event_id", signature.content_key("event_type", "props").alias("key"))


@query("d88_signature_key", "SELECT event_id, event_type || '|' || props || '|h' || user_id AS key FROM events")
def signature_key(spark, d):
    return table(spark, d, "events").select("event_id", signature.signature_key("event_type", "props", F.concat(F.lit("h"), F.col("user_id").cast("string"))).alias("key"))


@query("d82_json_numbers", "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k, 0.0::DOUBLE AS absent FROM events")
def json_numbers(spark, d):
    return table(spark, d, "events").select("event_id", classify.number(F.get_json_object("props", "$.k")).alias("k"), classify.number(F.get_json_object("props", "$.x")).alias("absent"))


@query("d22_levels", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'fatal' WHEN 'O' THEN 'warning' ELSE 'error' END AS level FROM orders")
def levels(spark, d):
    raw = classify.chosen(F.col("o_orderstatus"), [("F", " Fatal"), ("O", "WARNING ")], "odd")
    return table(spark, d, "orders").select("o_orderkey", classify.level(raw).alias("level"))


@query("d51_terms", "SELECT conv_id, turn, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:3], ',') AS terms FROM (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{4,}'), lambda w: w NOT IN ('with', 'from', 'this', 'that', 'error', 'failed')) AS w FROM conversations)")
def terms(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(textnorm.corpus_terms("text"), ",").alias("terms"))


@query("d47_unit_names", "SELECT s_suppkey, 'pay-' || s_suppkey || '.service' AS unit, 'a_2d' || s_suppkey AS escaped FROM supplier")
def unit_names(spark, d):
    n = F.col("s_suppkey").cast("string")
    return table(spark, d, "supplier").select("s_suppkey", classify.unit_of_object_path(F.concat(F.lit("/org/x/unit/pay_2d"), n, F.lit("_2eservice"))).alias("unit"), classify.escape_unit(F.concat(F.lit("a-"), n)).alias("escaped"))


@query("d85_jitter", fold_sql.JITTER)
def jitter(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", classify.jittered(F.lit(60_000_000_000), 0.1, "s_name").alias("interval_ns"))


@query("d56_redaction")
def redaction(spark, d):
    return redact.scrub(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "text", "redactions")


@query("d71_boundary_scan", "SELECT conv_id, turn, false AS leaks FROM conversations")
def boundary_scan(spark, d):
    out = redact.scrub(table(spark, d, "conversations").select("conv_id", "turn", "text"), "text")
    return out.select("conv_id", "turn", redact.leaks(F.col("text")).alias("leaks"))


@query("e36_redactions_by_rule")
def redactions_by_rule(spark, d):
    return redact.by_rule(redact.scrub(table(spark, d, "documents").select("doc_id", "text"), "text"))
