"""Queries of issues, skills, research and board rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import desk, incidents
from .catalog import query, table
from .stream_queries import R, now, records


@query("f36_suppressed", f"WITH {R}, d AS (SELECT scope, ts AS from_ts, ts + INTERVAL 12 HOUR AS until_ts FROM r WHERE k = 3) SELECT seq, EXISTS (SELECT 1 FROM d WHERE d.scope = r.scope AND r.ts >= d.from_ts AND r.ts < d.until_ts) AS suppressed FROM r")
def suppressed(spark, d):
    rows = records(spark, d)
    declared = rows.where("k = 3").select("scope", F.col("ts").alias("from_ts"), (F.col("ts") + F.expr("interval 12 hours")).alias("until_ts"))
    return desk.suppressed(rows.select("seq", "ts", "scope"), declared).select("seq", "suppressed")


@query("f37_elapsed_suppression", f"WITH {R} SELECT scope, CASE WHEN count_if(k % 9 = 0) > 0 THEN 'recorded' WHEN scope % 2 = 0 THEN 'resolved' ELSE 'suppressed' END AS state FROM r GROUP BY scope")
def elapsed(spark, d):
    rows = records(spark, d)
    scopes = rows.select("scope").distinct()
    verdicts = scopes.select("scope", F.when(F.col("scope") % 2 == 0, "passed").otherwise("failed").alias("verdict"))
    return desk.elapsed_suppression(scopes, rows.withColumn("suppressed", F.col("k") % 9 == 0), verdicts)


@query("f38_recurrences", f"WITH {R} SELECT seq, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY scope ORDER BY ts, seq) > 43200 * 1000000::BIGINT, true) AS recurrence FROM r")
def recurrences(spark, d):
    return desk.recurrences(records(spark, d), 43200, "scope").select("seq", "recurrence")


@query("f41_quiet_close", f"WITH {R} SELECT scope, max(ts) <= TIMESTAMP '2024-01-20' AND max(k) > 50 AND count_if(kind = 'canary') > 0 AND count_if(kind = 'gap' AND k = 9) = 0 AND scope % 3 <> 0 AS close FROM r GROUP BY scope")
def quiet_close(spark, d):
    return quiet_of(records(spark, d))


def quiet_of(records):
    rows = records.groupBy("scope").agg(
        F.max("ts").alias("last_ts"), F.when(F.max("k") > 50, "resolved").otherwise("verifying").alias("state"), (F.count_if(F.col("kind") == "canary") > 0).alias("canary_seen"), F.count_if((F.col("kind") == "gap") & (F.col("k") == 9)).alias("gaps")
    )
    return desk.quiet_gates(rows.withColumn("manual", F.col("scope") % 3 == 0), 0, now()).select("scope", "close")


@query("f42_two_strikes", f"WITH {R} SELECT seq, strikes FROM (SELECT seq, count(*) OVER (PARTITION BY scope ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS strikes FROM r WHERE source = 'error') WHERE strikes >= 2")
def two_strikes(spark, d):
    return desk.strikes(records(spark, d).where("source = 'error'"), 1, 2, "scope").select("seq", "strikes")


@query("f26_regressions", f"WITH {R} SELECT sig, seq, release, '1.3' AS resolved_release FROM r WHERE release > '1.3' AND scope % 5 = 0")
def regressions(spark, d):
    rows = records(spark, d)
    return desk.regressions(rows.select("sig", "seq", "release"), rows.where("scope % 5 = 0").select("sig").distinct().withColumn("resolved_release", F.lit("1.3")))


@query("e46_releases", f"WITH {R}, x AS (SELECT release, min(seq) AS first_seq FROM r GROUP BY 1) SELECT release, first_seq, rank() OVER (ORDER BY release) - 1 AS after FROM x")
def releases(spark, d):
    return desk.releases_in_order(records(spark, d))


@query("c35_skill_holds", "SELECT DISTINCT p_type AS name, p_size AS version FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_partkey % 50 = 7)")
def skill_holds(spark, d):
    parts = table(spark, d, "part")
    skills = parts.groupBy(F.col("p_type").alias("name"), F.col("p_size").alias("version")).agg(F.collect_set("p_brand").alias("sigs"))
    windows = parts.where("p_partkey % 50 = 7").select(F.col("p_brand").alias("sig"), F.lit(False).alias("passed"))
    return desk.held_skills(skills, windows)


@query("c36_canary_green", f"WITH {R}, c AS (SELECT source AS name, release AS version, arg_max({{'ok': k % 2 = 0, 'ts': ts}}, ts) AS c FROM r WHERE kind = 'canary' GROUP BY 1, 2), s AS (SELECT DISTINCT source AS name, release AS version FROM r) SELECT name, version, coalesce(c.c.ok AND c.c.ts >= TIMESTAMP '2024-01-20' - INTERVAL 1 DAY, false) AS green FROM s LEFT JOIN c USING (name, version)")
def canary_green(spark, d):
    rows = records(spark, d).select(F.col("source").alias("name"), F.col("release").alias("version"), "kind", "ts", (F.col("k") % 2 == 0).alias("ok"))
    return desk.canary_green(rows.select("name", "version").distinct(), rows.where("kind = 'canary'").withColumn("host", F.lit("h")), "h", now(), 86400)


@query("c40_grants", f"WITH {R} SELECT seq, CASE WHEN scope = 3 AND source = 'click' THEN 'exact' WHEN source = 'click' THEN 'wide' END AS \"grant\" FROM r")
def grants(spark, d):
    rows = records(spark, d).select("seq", "scope", F.col("source").alias("rule"), F.lit("m").alias("module"), "sig")
    exact = rows.where("rule = 'click' and scope = 3").select(F.concat_ws("|", "rule", "module", F.substring_index("sig", ":", -1)).alias("key"), F.lit("exact").alias("grant")).distinct()
    return desk.granted(rows, exact.unionByName(spark.createDataFrame([("click|m", "wide")], "key string, grant string"))).select("seq", "grant")


@query("c41_project_keys", "SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'unknown_key' WHEN o_custkey % 7 = 1 AND o_orderdate >= TIMESTAMP '1996-01-01' THEN 'expired_key' END AS error FROM orders")
def project_keys(spark, d):
    requests = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("k"), (F.col("o_custkey") % 7).cast("string")).alias("key"), F.col("o_orderdate").alias("ts"))
    keys = spark.createDataFrame([(f"k{i}", f"p{i}", "1996-01-01" if i == 1 else None) for i in range(1, 7)], "key string, project string, valid_until string").withColumn("valid_until", F.to_timestamp_ntz("valid_until"))
    return desk.project_of_key(requests, keys).select("o_orderkey", "error")


@query("e35_status_line", "SELECT string_agg(o_orderstatus || '=' || n, ' ' ORDER BY o_orderstatus) AS line FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)")
def status_line(spark, d):
    return desk.status_line(table(spark, d, "orders"), "o_orderstatus")


@query("e39_board_summary", "SELECT o_orderpriority, count(*) AS n, count_if(o_orderstatus = 'F') AS done FROM orders GROUP BY 1")
def board_summary(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))


@query("g14_newest_answer", "SELECT o_custkey AS question, arg_min(o_orderkey, (o_orderstatus <> 'F', -epoch_us(o_orderdate), o_orderkey)) AS answer FROM orders GROUP BY 1")
def newest_answer(spark, d):
    return desk.newest_answer(table(spark, d, "orders").select(F.col("o_custkey").alias("question"), F.col("o_orderkey").alias("answer"), (F.col("o_orderstatus") == "F").alias("primary"), F.col("o_orderdate").alias("mtime")))


@query("g15_highest_tag", "SELECT 'v' || max(s_suppkey) || '.0.1' AS tag FROM supplier WHERE s_suppkey % 2 = 0")
def highest_tag(spark, d):
    n = F.col("s_suppkey").cast("string")
    return desk.highest_tag(table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("v"), n, F.lit(".0.1"))).otherwise(F.concat(F.lit("x"), n)).alias("name")))


@query("c26_story", f"WITH {R}, x AS (SELECT scope, kind, value, seq, row_number() OVER (PARTITION BY scope ORDER BY seq DESC) AS n FROM r) SELECT 'i' || scope AS inc, kind, arg_max(value, seq) AS value, count(*) AS n FROM x WHERE n <= 20 GROUP BY 1, 2")
def story(spark, d):
    rows = records(spark, d).select(F.concat(F.lit("i"), F.col("scope").cast("string")).alias("inc"), "kind", "seq", "value")
    return desk.story(rows, 20)


@query("f52_steps", "SELECT o_orderkey::VARCHAR AS inc, step, ts, row_number() OVER (PARTITION BY o_orderkey ORDER BY ts, i)::INTEGER AS place FROM (SELECT o_orderkey, 'opened' AS step, o_orderdate AS ts, 0 AS i FROM orders UNION ALL SELECT o_orderkey, 'played', o_orderdate + INTERVAL 1 HOUR, 1 FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'resolved', o_orderdate - INTERVAL 1 HOUR, 2 FROM orders WHERE o_orderkey % 3 = 0)")
def timeline_steps(spark, d):
    o = table(spark, d, "orders")
    at = lambda n, s: F.when(F.col("o_orderkey") % n == 0, F.col("o_orderdate") + F.expr(f"interval {s} hours"))
    rows = o.select(F.col("o_orderkey").cast("string").alias("inc"), F.col("o_orderdate").alias("a"), at(2, 1).alias("b"), at(3, -1).alias("c"))
    return desk.steps(rows, {"opened": "a", "played": "b", "resolved": "c"})


@query("b32_summaries", "SELECT c_custkey, substr(array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END, c_mktsegment, c_nationkey::VARCHAR], lambda x: x <> ''), ' · '), 1, 200) AS line FROM customer")
def summaries(spark, d):
    rows = table(spark, d, "customer").withColumn("title", F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_name")))
    return rows.select("c_custkey", desk.summary(["title", "c_mktsegment", "c_nationkey"]).alias("line"))


@query("b27_best_answers", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS answer FROM supplier")
def best_answers(spark, d):
    forms = {0: '[{"text":" "},{"text":"a"}]', 1: '{"answers":[{"text":""},{"text":"b"}]}'}
    json = F.when(F.col("s_suppkey") % 3 == 0, forms[0]).when(F.col("s_suppkey") % 3 == 1, forms[1]).otherwise('{"text":"c"}')
    return table(spark, d, "supplier").select("s_suppkey", desk.best_answer(json).alias("answer"))


@query("d34_merge_subjects", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 3 = 1 THEN 'hosts' ELSE 'abc' END AS subject FROM supplier")
def merge_subjects(spark, d):
    key = F.when(F.col("s_suppkey") % 3 == 0, "subject").when(F.col("s_suppkey") % 3 == 1, "host").otherwise("other")
    payload = F.to_json(F.create_map(key, F.col("s_name")))
    return table(spark, d, "supplier").select("s_suppkey", desk.merge_subject(payload, [("host", "hosts")], F.lit("psi:sha256v1:abc")).alias("subject"))


@query("d106_issue_bodies", "SELECT n_nationkey, '<!-- sig: s' || n_nationkey || ' -->' || chr(10) || '## ' || n_name || chr(10) || '| field | value |' || chr(10) || '|---|---|' || chr(10) || '| region | ' || n_regionkey || ' |' || chr(10) || '```' || chr(10) || n_name || chr(10) || '```' || chr(10) AS body FROM nation")
def issue_bodies(spark, d):
    rows = table(spark, d, "nation").withColumn("sig", F.concat(F.lit("s"), F.col("n_nationkey").cast("string")))
    return rows.select("n_nationkey", desk.issue_body("n_name", [("region", "n_regionkey")], "n_name").alias("body"))


@query("d108_labels", f"WITH {R} SELECT DISTINCT sig, 'source:generic' AS label FROM r")
def labels(spark, d):
    return records(spark, d).select("sig", desk.source_label(F.col("sig")).alias("label")).distinct()


@query("c18_droppable", "WITH g AS (SELECT c_custkey::VARCHAR AS file, c_custkey AS first_seq FROM customer), m AS (SELECT o_custkey::VARCHAR AS file, arg_max(CASE o_orderstatus WHEN 'F' THEN 'verified' ELSE 'pending' END, o_orderkey) AS state FROM orders GROUP BY 1) SELECT file, coalesce(state = 'verified', false) AS drop_it FROM (SELECT *, row_number() OVER (ORDER BY first_seq DESC) AS n FROM g) LEFT JOIN m USING (file) WHERE n > 30")
def droppable(spark, d):
    generations = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("file"), F.col("c_custkey").alias("first_seq"))
    markers = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("file"), F.col("o_orderkey").alias("line"), F.when(F.col("o_orderstatus") == "F", "verified").otherwise("pending").alias("state"))
    return incidents.droppable(generations, markers, 30).select("file", F.col("drop").alias("drop_it"))


@query("h5_sorted_distinct", "SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS segments FROM customer GROUP BY 1")
def sorted_distinct(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.array_distinct(F.collect_set("c_mktsegment"))), ",").alias("segments"))


@query("h8_missing_modules", "SELECT n_regionkey, array_to_string(list_sort(list(DISTINCT n_name) FILTER (WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 9 = 1))), ',') AS missing FROM nation GROUP BY 1")
def missing_modules(spark, d):
    need = table(spark, d, "nation")
    have = table(spark, d, "supplier").where("s_suppkey % 9 = 1").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    names = lambda df, c: df.groupBy("n_regionkey").agg(F.collect_set("n_name").alias(c))
    both = names(need, "needed").join(names(need.join(have, "n_nationkey"), "had"), "n_regionkey", "left")
    lost = F.array_sort(F.array_except("needed", F.coalesce("had", F.array().cast("array<string>"))))
    return both.select("n_regionkey", F.when(F.size(lost) > 0, F.array_join(lost, ",")).alias("missing"))
