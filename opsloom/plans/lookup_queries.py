"""Queries that read one thing by another, and what is kept of each: lookups, bundles, retention, caps, counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, signature
from ..operators import groups, incidents, lookups, retention, verify
from .catalog import query, table
from .stream_queries import FOLD, INC, R, folded, incident_rows, now, records

OPEN = "coalesce(state, '') NOT IN ('resolved', 'suppressed', 'quarantined', '')"
#: Links of a signature or a correlation key to incidents, and the folds of these.
LINKS = f"{R}, {INC}, f AS ({FOLD}), l AS (SELECT sig, 'key' || (scope % 20) AS in_key, 'inc_' || (k % 40) AS inc, seq FROM r)"
BY_SIG = f"bs AS (SELECT sig, arg_max(inc, seq) AS inc FROM (SELECT sig, inc, max(seq) AS seq FROM l GROUP BY 1, 2) JOIN f USING (inc) WHERE {OPEN} GROUP BY 1)"
BY_KEY = f"bk AS (SELECT in_key, arg_max(inc, seq) AS inc FROM (SELECT in_key, inc, max(seq) AS seq FROM l GROUP BY 1, 2) JOIN f USING (inc) WHERE {OPEN} GROUP BY 1)"


def links(spark, d):
    return records(spark, d).select("sig", F.concat(F.lit("key"), (F.col("scope") % 20).cast("string")).alias("in_key"), F.concat(F.lit("inc_"), (F.col("k") % 40).cast("string")).alias("inc"), "seq")


# ---------------------------------------------------------------- incidents and groups by a key
@query("c2_all_gaps", f"WITH {R}, {INC}, f AS ({FOLD}) SELECT inc, state, (SELECT count(*) FROM r WHERE kind = 'gap') AS gaps, (SELECT min(seq) FROM r WHERE kind = 'gap') AS first_gap, (SELECT max(seq) FROM r WHERE kind = 'gap') AS last_gap FROM f")
def all_gaps(spark, d):
    return lookups.with_all_gaps(folded(spark, d).select("inc", "state"), records(spark, d))


@query("c8_digest_of_merge_key", f"WITH {R} SELECT 'mk' || (scope % 50) AS key, arg_max(split_part(sig, ':', 3), seq) AS value FROM r GROUP BY 1")
def digest_of_merge_key(spark, d):
    rows = records(spark, d).withColumn("key", F.concat(F.lit("mk"), (F.col("scope") % 50).cast("string")))
    return groups.lookup(rows, "key", signature.parsed(F.col("sig"))["digest"])


@query(
    "c9_incident_of_sig",
    f"WITH {LINKS}, x AS (SELECT sig, inc, seq, state FROM (SELECT sig, inc, max(seq) AS seq FROM l GROUP BY 1, 2) JOIN f USING (inc)) SELECT sig, coalesce(arg_max(inc, seq) FILTER (WHERE {OPEN}), arg_max(inc, seq)) AS inc FROM x GROUP BY 1",
)
def incident_of_sig(spark, d):
    return lookups.incident_of_key(links(spark, d), folded(spark, d))


@query("c9b_resolved_in_window", f"WITH {R}, {INC}, x AS (SELECT sig, arg_max(inc, seq) AS inc, arg_max(ts, seq) AS seen FROM i WHERE state = 'resolved' GROUP BY 1) SELECT sig, inc FROM x WHERE epoch_us(TIMESTAMP '2024-01-20') - epoch_us(seen) <= 5 * 86400 * 1000000::BIGINT")
def resolved_in_window(spark, d):
    return lookups.resolved_within(incident_rows(spark, d), now(), 5 * 86400)


@query("c27_incident_by_id", f"WITH {R}, {INC}, f AS ({FOLD}) SELECT * FROM f WHERE inc = 'inc_7'")
def incident_by_id(spark, d):
    return folded(spark, d).where("inc = 'inc_7'")


@query("c28_incident_by_sig", f"WITH {LINKS}, {BY_SIG} SELECT bs.sig, f.inc, f.state, f.severity, f.last_seq FROM bs JOIN f USING (inc)")
def incident_by_sig(spark, d):
    incs = folded(spark, d)
    return lookups.open_by_key(links(spark, d), incs, "sig").join(incs, "inc").select("sig", "inc", "state", "severity", "last_seq")


@query(
    "c29_group_by_sig",
    f"WITH {R}, a AS (SELECT sig, split_part(min(sig) OVER (PARTITION BY scope % 50), ':', 3) AS digest, seq, ts, release FROM r), g AS (SELECT digest, count(*) AS n, max(seq) AS last_seq FROM a GROUP BY 1) SELECT DISTINCT a.sig, g.digest, g.n, g.last_seq FROM a JOIN g USING (digest)",
)
def group_by_sig(spark, d):
    """Signatures under one merge key are one group: the alias names its digest, and the group answers for each of them."""
    rows = records(spark, d).withColumn("mk", F.col("scope") % 50)
    alias = rows.groupBy("mk").agg(F.min("sig").alias("first")).select("mk", signature.parsed(F.col("first"))["digest"].alias("digest"))
    named = rows.join(alias, "mk")
    stats = named.groupBy("digest").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))
    return named.select("sig", "digest").distinct().join(stats, "digest").select("sig", "digest", "n", "last_seq")


@query("c30_group_by_digest", f"WITH {R} SELECT split_part(sig, ':', 3) AS digest, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM r WHERE split_part(sig, ':', 3) = substr(sha256('generic' || chr(31) || 'click' || chr(31) || '7' || chr(30)), 1, 16) GROUP BY 1")
def group_by_digest(spark, d):
    wanted = F.substring_index(signature.signature("generic", F.lit("click"), F.lit("7")), ":", -1)
    return records(spark, d).withColumn("digest", F.substring_index("sig", ":", -1)).where(F.col("digest") == wanted).groupBy("digest").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("c31_cold_evidence", f"WITH {R}, {INC} SELECT seq, kind, sig FROM i WHERE inc = 'inc_7' ORDER BY seq LIMIT 512")
def cold_evidence(spark, d):
    return incident_rows(spark, d).where("inc = 'inc_7'").orderBy("seq").limit(512).select("seq", "kind", "sig")


@query("c32_open_by_key", f"WITH {LINKS}, {BY_KEY} SELECT in_key, inc FROM bk")
def open_by_key(spark, d):
    return lookups.open_by_key(links(spark, d), folded(spark, d), "in_key")


@query("c33_open_for_pair", f"WITH {LINKS}, {BY_SIG}, {BY_KEY} SELECT p.sig, p.in_key, coalesce(bs.inc, bk.inc) AS inc FROM (SELECT DISTINCT sig, in_key FROM l) AS p LEFT JOIN bs USING (sig) LEFT JOIN bk USING (in_key)")
def open_for_pair(spark, d):
    all_links, incs = links(spark, d), folded(spark, d)
    return lookups.open_for_pair(all_links.select("sig", "in_key").distinct(), lookups.open_by_key(all_links, incs, "sig"), lookups.open_by_key(all_links, incs, "in_key"), "sig", "in_key")


@query("c15_correlation_merge", f"WITH {LINKS} SELECT in_key, count(DISTINCT sig) AS sigs, min(seq) AS first_seq, count(*) AS arrivals FROM l GROUP BY 1")
def correlation_merge(spark, d):
    return links(spark, d).groupBy("in_key").agg(F.count_distinct("sig").alias("sigs"), F.min("seq").alias("first_seq"), F.count("*").alias("arrivals"))


# ---------------------------------------------------------------- bundles, anchors, dimensions
@query(
    "c10_rule_rows",
    f"WITH {R}, s AS (SELECT 'rule' || (k % 20) AS rule, count(*) AS fires, max(ts) AS last_ts FROM r WHERE kind = 'event' GROUP BY 1), b AS (SELECT 'rule' || (k % 15) AS rule, arg_max(CASE k % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'half_open' ELSE 'closed' END, seq) AS breaker FROM r WHERE kind = 'canary' GROUP BY 1) "
    "SELECT 'rule' || n_nationkey AS rule, n_name AS name, coalesce(fires, 0) AS fires, last_ts, coalesce(breaker, 'closed') AS breaker FROM nation LEFT JOIN s ON s.rule = 'rule' || n_nationkey LEFT JOIN b ON b.rule = 'rule' || n_nationkey",
)
def rule_rows(spark, d):
    rows = records(spark, d)
    of = lambda n: F.concat(F.lit("rule"), (F.col("k") % n).cast("string")).alias("rule")
    stats = rows.where("kind = 'event'").groupBy(of(20)).agg(F.count("*").alias("fires"), F.max("ts").alias("last_ts"))
    state = classify.chosen(F.col("k") % 3, [(0, "open"), (1, "half_open")], "closed")
    breakers = rows.where("kind = 'canary'").groupBy(of(15)).agg(F.max_by(state, "seq").alias("breaker"))
    rules = table(spark, d, "nation").select(F.concat(F.lit("rule"), F.col("n_nationkey").cast("string")).alias("rule"), F.col("n_name").alias("name"))
    return lookups.rule_rows(rules, stats, breakers)


_GROUPS = "g AS (SELECT sig, arg_max(source, seq) AS source, count(*) AS n, arg_max(CASE WHEN k % 2 = 0 THEN '' ELSE release END, seq) AS release FROM r GROUP BY 1), run AS (SELECT source, arg_max(release, seq) AS running FROM r GROUP BY 1)"


def _bundles(spark, d):
    rows = records(spark, d)
    found = rows.groupBy("sig").agg(F.max_by("source", "seq").alias("source"), F.count("*").alias("n"), F.max_by(F.when(F.col("k") % 2 == 0, "").otherwise(F.col("release")), "seq").alias("release"))
    running = rows.groupBy("source").agg(F.max_by("release", "seq").alias("running"))
    return lookups.bundle(found, lookups.open_by_key(links(spark, d), folded(spark, d), "sig"), running)


@query("c14_bundle_of_sig", f"WITH {LINKS}, {BY_SIG}, {_GROUPS} SELECT sig, source, n, release, inc FROM g LEFT JOIN bs USING (sig)")
def bundle_of_sig(spark, d):
    return _bundles(spark, d).select("sig", "source", "n", "release", "inc")


@query("c38_cross_plane", f"WITH {LINKS}, {BY_SIG}, {_GROUPS} SELECT sig, inc, n, coalesce(nullif(running, ''), nullif(release, '')) AS release FROM g LEFT JOIN bs USING (sig) LEFT JOIN run USING (source) WHERE NOT coalesce(nullif(release, '') <> nullif(running, ''), false)")
def cross_plane(spark, d):
    return _bundles(spark, d).where("bundle is not null").select("sig", "bundle.*")


@query("c39_group_sample", f"WITH {R} SELECT sig, min(seq) AS sample, arg_min(source, seq) AS source FROM r GROUP BY 1")
def group_sample(spark, d):
    return records(spark, d).groupBy("sig").agg(F.min("seq").alias("sample"), F.min_by("source", "seq").alias("source"))


@query("c19_release_pair", f"WITH {R}, x AS (SELECT DISTINCT scope, release FROM r) SELECT scope, release, lag(release) OVER (PARTITION BY scope ORDER BY split_part(release, '.', 1)::BIGINT, split_part(release, '.', 2)::BIGINT) AS previous FROM x")
def release_pair(spark, d):
    return lookups.previous_release(records(spark, d), "scope")


@query("c21_anchors", f"WITH {R}, a AS (SELECT source AS driver, sig, scope % 5 AS project, arg_max('issue' || seq, seq) AS issue FROM r WHERE kind <> 'event' GROUP BY 1, 2, 3) SELECT x.driver, x.sig, x.project, a.issue FROM (SELECT DISTINCT source AS driver, sig, scope % 5 AS project FROM r) AS x LEFT JOIN a USING (driver, sig, project)")
def anchors(spark, d):
    rows = records(spark, d).select(F.col("source").alias("driver"), "sig", (F.col("scope") % 5).alias("project"), "kind", "seq", F.concat(F.lit("issue"), F.col("seq").cast("string")).alias("issue"))
    return rows.select("driver", "sig", "project").distinct().join(lookups.anchors(rows.where("kind <> 'event'")), ["driver", "sig", "project"], "left")


@query("c23_idempotency_tail", f"WITH {R} SELECT 'content:' || seq AS key FROM r ORDER BY seq DESC LIMIT 1000")
def idempotency_tail(spark, d):
    return records(spark, d).orderBy(F.col("seq").desc()).limit(1000).select(F.concat(F.lit("content:"), F.col("seq").cast("string")).alias("key"))


@query("c24_board_row_by_sig", f"WITH {R}, b AS (SELECT sig, max(seq) AS row_id FROM r WHERE kind = 'event' GROUP BY 1) SELECT r.seq, b.row_id FROM r LEFT JOIN b USING (sig)")
def board_row_by_sig(spark, d):
    rows = records(spark, d)
    return rows.join(rows.where("kind = 'event'").groupBy("sig").agg(F.max("seq").alias("row_id")), "sig", "left").select("seq", "row_id")


@query("c34_held_by", f"WITH {R} SELECT seq, CASE WHEN k % 7 = 2 THEN 'rule:2' WHEN k % 7 = 5 THEN 'rule:5' WHEN source = 'click' THEN 'source:click' END AS held_by FROM r")
def held_by(spark, d):
    breakers = spark.createDataFrame([("rule:2", "open"), ("rule:3", "closed"), ("rule:5", "half_open"), ("source:click", "open"), ("global", "closed")], "scope string, state string")
    scopes = F.array(F.col("sig"), F.concat(F.lit("rule:"), (F.col("k") % 7).cast("string")), F.concat(F.lit("source:"), F.col("source")), F.lit("global"))
    return lookups.held_by(records(spark, d), scopes, breakers).select("seq", "held_by")


@query(
    "c37_signers",
    "SELECT c_custkey, CASE WHEN n_name IS NULL THEN 'unknown_signer' WHEN n_regionkey = 2 THEN 'disabled_signer' WHEN n_regionkey = 3 THEN 'unknown_trust' END AS error FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 4) ON n_nationkey = c_nationkey",
)
def signers(spark, d):
    known = table(spark, d, "nation").where("n_regionkey <> 4").select(F.col("n_nationkey").alias("key_id"), F.col("n_name").alias("name"), (F.col("n_regionkey") != 2).alias("enabled"), classify.chosen(F.col("n_regionkey"), [(3, "rumour"), (0, "root")], "delegate").alias("trust"))
    return lookups.signers_of(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("key_id")), known).select("c_custkey", "error")


@query("a52_new_board_rows", f"WITH {R} SELECT sig, count(*) AS n FROM r WHERE kind = 'gap' AND sig NOT IN (SELECT sig FROM r WHERE kind = 'event') GROUP BY 1")
def new_board_rows(spark, d):
    rows = records(spark, d)
    return lookups.new_rows(rows.where("kind = 'gap'"), rows.where("kind = 'event'")).groupBy("sig").agg(F.count("*").alias("n"))


@query(
    "a72_board_events",
    f"WITH {R}, e AS (SELECT DISTINCT scope AS task, source AS type, 'd' || (k % 3) AS dedup FROM r WHERE kind = 'event'), w AS (SELECT seq, scope AS task, CASE WHEN k % 2 = 0 THEN 'click' ELSE 'purchase' END AS type, CASE WHEN k % 5 = 0 THEN '' ELSE 'd' || (k % 3) END AS dedup FROM r) SELECT seq, EXISTS (SELECT 1 FROM e WHERE e.task = w.task AND e.type = w.type AND (w.dedup = '' OR w.dedup = e.dedup)) AS known FROM w",
)
def board_events(spark, d):
    rows = records(spark, d)
    events = rows.where("kind = 'event'").select(F.col("scope").alias("task"), F.col("source").alias("type"), F.concat(F.lit("d"), (F.col("k") % 3).cast("string")).alias("dedup"))
    wanted = rows.select("seq", F.col("scope").alias("task"), F.when(F.col("k") % 2 == 0, "click").otherwise("purchase").alias("type"), F.when(F.col("k") % 5 == 0, "").otherwise(F.concat(F.lit("d"), (F.col("k") % 3).cast("string"))).alias("dedup"))
    return lookups.has_event(wanted, events).select("seq", "known")


# ---------------------------------------------------------------- cold folds, totals, retention
@query("e3_cold_ranking", f"WITH {R} SELECT sig, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, sig LIMIT 50")
def cold_ranking(spark, d):
    return groups.top_groups(records(spark, d).groupBy("sig").agg(F.count("*").alias("n")), 50)


@query("e4_cold_group", f"WITH {R} SELECT scope, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq, min(ts) AS first_ts, max(ts) AS last_ts FROM r WHERE scope = 7 GROUP BY 1")
def cold_group(spark, d):
    return records(spark, d).where("scope = 7").groupBy("scope").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("e7_source_fold", f"WITH {R} SELECT source, kind, max(seq) AS last_seq, max(ts) AS last_ts, count(*) AS n, arg_max(scope, seq) AS last_scope FROM r GROUP BY 1, 2")
def source_fold(spark, d):
    return records(spark, d).groupBy("source", "kind").agg(F.max("seq").alias("last_seq"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.max_by("scope", "seq").alias("last_scope"))


DAYS = "dt AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows, sum(k)::BIGINT AS bytes, min(seq) AS first_seq, max(seq) AS last_seq, min(ts) AS min_ts, max(ts) AS max_ts FROM r GROUP BY 1)"


def days(spark, d):
    return retention.day_totals(records(spark, d), F.col("k").cast("long"))


@query("e53_day_totals", f"WITH {R}, {DAYS} SELECT * FROM dt")
def day_totals(spark, d):
    return days(spark, d)


@query("e12_eligible_days", f"WITH {R}, {DAYS} SELECT day, bytes FROM dt WHERE date_diff('day', day::DATE, DATE '2024-01-20') >= 7 AND bytes >= 1000")
def eligible_days(spark, d):
    return retention.eligible_days(days(spark, d), F.lit("2024-01-20").cast("date"), 7, 1000).select("day", "bytes")


@query("e13_expired_days", f"WITH {R}, {DAYS} SELECT day, rows FROM dt WHERE date_diff('day', day::DATE, DATE '2024-01-20') > 10")
def expired_days(spark, d):
    return retention.expired_days(days(spark, d), F.lit("2024-01-20").cast("date"), 10).select("day", "rows")


@query("e20_backpressure", f"WITH {R} SELECT scope, count_if(k >= 50) AS folds, sum(CASE WHEN k >= 50 THEN k ELSE 0 END)::BIGINT AS lost FROM r WHERE kind = 'gap' GROUP BY 1")
def backpressure(spark, d):
    return retention.backpressure(records(spark, d).where("kind = 'gap'"), F.col("k") >= 50)


DISPOSED = "x AS (SELECT *, CASE k % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'folded' WHEN 2 THEN 'dropped' ELSE 'suppressed' END AS disposition FROM r)"


def disposed(spark, d):
    return records(spark, d).withColumn("disposition", classify.chosen(F.col("k") % 4, [(0, "accepted"), (1, "folded"), (2, "dropped")], "suppressed"))


@query("e26_project_counters", f"WITH {R}, {DISPOSED} SELECT scope, count_if(disposition = 'accepted') AS accepted, count_if(disposition = 'folded') AS folded, count_if(disposition = 'dropped') AS dropped FROM x GROUP BY 1")
def project_counters(spark, d):
    return retention.disposition_counts(disposed(spark, d), ["scope"], ["accepted", "folded", "dropped"])


@query("e43_dropped_groups", f"WITH {R}, {DISPOSED} SELECT sig, count_if(disposition = 'dropped') AS dropped, count_if(disposition = 'suppressed') AS suppressed FROM x GROUP BY 1")
def dropped_groups(spark, d):
    return retention.disposition_counts(disposed(spark, d), ["sig"], ["dropped", "suppressed"])


_AGE = "epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts)"


@query("e30_cap_counters", f"WITH {R}, x AS (SELECT scope % 5 AS project, {_AGE} AS age FROM r) SELECT project, count_if(age < 3600000000) AS hour, count_if(age < 86400000000) AS day FROM x WHERE age >= 0 AND age < 86400000000 GROUP BY 1")
def cap_counters(spark, d):
    return retention.trailing_counts(records(spark, d).withColumn("project", F.col("scope") % 5), now(), {"hour": 3600, "day": 86400}, ["project"])


@query("e50_cap_snapshot", f"WITH {R}, x AS (SELECT sig, {_AGE} AS age FROM r) SELECT sig, count_if(age < 3600000000) AS hour, count_if(age < 86400000000) AS day, count_if(age < 604800000000) AS week FROM x WHERE age >= 0 AND age < 604800000000 GROUP BY 1")
def cap_snapshot(spark, d):
    return retention.trailing_counts(records(spark, d), now(), {"hour": 3600, "day": 86400, "week": 7 * 86400}, ["sig"])


@query("e31_recent_anchors", f"WITH {R} SELECT source AS driver, sig, scope % 5 AS project, arg_max('issue' || seq, seq) AS issue FROM r WHERE {_AGE} >= 0 AND {_AGE} < 86400000000 GROUP BY 1, 2, 3")
def recent_anchors(spark, d):
    recent = records(spark, d).where((F.col("ts") <= now()) & (F.col("ts") > now() - F.expr("interval 24 hours")))
    return lookups.anchors(recent.select(F.col("source").alias("driver"), "sig", (F.col("scope") % 5).alias("project"), "seq", F.concat(F.lit("issue"), F.col("seq").cast("string")).alias("issue")))


@query("e37_archive_status", f"WITH {R}, m AS (SELECT scope AS file, arg_max(CASE k % 3 WHEN 0 THEN 'exported' WHEN 1 THEN 'verified' ELSE 'dropped' END, seq) AS state, max(ts) AS seen FROM r GROUP BY 1) SELECT count(*) AS files, count_if(state = 'exported') AS exported, count_if(state = 'verified') AS verified, count_if(state = 'dropped') AS dropped, max(seen) AS last_ts FROM m")
def archive_status(spark, d):
    state = classify.chosen(F.col("k") % 3, [(0, "exported"), (1, "verified")], "dropped")
    files = records(spark, d).groupBy("scope").agg(F.max_by(state, "seq").alias("state"), F.max("ts").alias("at"))
    return files.agg(F.count("*").alias("files"), *(F.count_if(F.col("state") == s).alias(s) for s in ("exported", "verified", "dropped")), F.max("at").alias("last_ts"))


@query("e40_index_statistics", f"WITH {R} SELECT count(*) AS records, count(DISTINCT sig) AS groups, count(DISTINCT source) AS sources, count(DISTINCT CAST(ts AS DATE)) AS days FROM r")
def index_statistics(spark, d):
    return records(spark, d).agg(F.count("*").alias("records"), F.count_distinct("sig").alias("groups"), F.count_distinct("source").alias("sources"), F.count_distinct(F.to_date("ts")).alias("days"))


@query("e48_arrival_liveness", f"WITH {R} SELECT 'host' || (scope % 3) AS host, source, max(ts) AS last_ts FROM r WHERE kind = 'event' GROUP BY 1, 2")
def arrival_liveness(spark, d):
    return records(spark, d).where("kind = 'event'").groupBy(F.concat(F.lit("host"), (F.col("scope") % 3).cast("string")).alias("host"), "source").agg(F.max("ts").alias("last_ts"))


@query("e49_budget_state", f"WITH {R}, u AS (SELECT source AS class, count(*) AS used FROM r WHERE CAST(ts AS DATE) = DATE '2024-01-19' GROUP BY 1), b AS (SELECT * FROM (VALUES ('click', 20), ('error', 5), ('research', 30)) AS v(class, most)) SELECT class, most::BIGINT AS most, coalesce(used, 0) AS used, greatest(most - coalesce(used, 0), 0) AS left, coalesce(used, 0) >= most AS exhausted FROM b LEFT JOIN u USING (class)")
def budget_state(spark, d):
    used = records(spark, d).where(F.to_date("ts") == F.lit("2024-01-19").cast("date")).groupBy(F.col("source").alias("class")).agg(F.count("*").alias("used"))
    return retention.budget_state(used, spark.createDataFrame([("click", 20), ("error", 5), ("research", 30)], "class string, most long"))


@query("e51_research_state", f"WITH {R}, t AS (SELECT * FROM r WHERE CAST(ts AS DATE) = DATE '2024-01-19') SELECT sig, arg_max(kind, seq) AS last_kind, count_if(source = 'click') AS submits, count_if(source = 'click' AND k >= 50) AS accepted FROM t GROUP BY 1")
def research_state(spark, d):
    today = records(spark, d).where(F.to_date("ts") == F.lit("2024-01-19").cast("date"))
    submit = F.col("source") == "click"
    return today.groupBy("sig").agg(F.max_by("kind", "seq").alias("last_kind"), F.count_if(submit).alias("submits"), F.count_if(submit & (F.col("k") >= 50)).alias("accepted"))


# ---------------------------------------------------------------- pages, rings, spools, eviction
@query("g6_ring_since", f"WITH {R} SELECT seq, sig FROM r WHERE seq > 100 ORDER BY seq DESC LIMIT 256")
def ring_since(spark, d):
    return records(spark, d).where("seq > 100").orderBy(F.col("seq").desc()).limit(256).select("seq", "sig")


@query("g10_incident_page", f"WITH {R}, {INC}, f AS ({FOLD}) SELECT inc, last_seq, (SELECT last_seq FROM f ORDER BY last_seq DESC LIMIT 1 OFFSET 9) AS next FROM f ORDER BY last_seq DESC LIMIT 10")
def incident_page(spark, d):
    rows = folded(spark, d).select("inc", F.col("last_seq").alias("seq"), F.lit("incident").alias("kind"))
    return incidents.page(rows, 10).select("inc", F.col("seq").alias("last_seq"), "next")


@query("g11_page_sizes", "SELECT p_partkey, CASE WHEN p_size - 10 <= 0 THEN 500 ELSE least((p_size - 10) * 200, 5000) END::BIGINT AS size FROM part")
def page_sizes(spark, d):
    asked = F.when(F.col("p_size") > 10, (F.col("p_size") - 10) * 200).otherwise(F.col("p_size") - 10)
    return table(spark, d, "part").select("p_partkey", incidents.clamped_size(asked).cast("long").alias("size"))


@query("g13_top_processes", "SELECT * FROM (SELECT 'cpu' AS by, p_partkey AS pid FROM part ORDER BY p_size DESC, p_partkey LIMIT 10) UNION ALL SELECT * FROM (SELECT 'rss' AS by, p_partkey AS pid FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10)")
def top_processes(spark, d):
    rows = table(spark, d, "part")
    top = lambda name, c: rows.orderBy(F.col(c).desc(), "p_partkey").limit(10).select(F.lit(name).alias("by"), F.col("p_partkey").alias("pid"))
    return top("cpu", "p_size").unionByName(top("rss", "p_retailprice"))


SPOOL = "s AS (SELECT scope % 20 AS project, seq, k::BIGINT AS bytes FROM r)"


def spool(spark, d):
    return records(spark, d).select((F.col("scope") % 20).alias("project"), "seq", F.col("k").cast("long").alias("bytes"))


@query("g17_budget_gaps", f"WITH {R}, {SPOOL}, o AS (SELECT *, sum(bytes) OVER (PARTITION BY project ORDER BY seq DESC) AS t FROM s) SELECT project, count(*) AS dropped, sum(bytes)::BIGINT AS bytes, min(seq) AS from_seq, max(seq) AS to_seq FROM o WHERE t > 700 GROUP BY 1")
def budget_gaps(spark, d):
    return retention.gap_rows(retention.over_budget(spool(spark, d), 700, "project"), "project")


@query("a64_spool_budget", f"WITH {R}, {SPOOL}, o AS (SELECT *, sum(bytes) OVER (PARTITION BY project ORDER BY seq DESC) AS t FROM s WHERE bytes <= 90) SELECT project, seq FROM o WHERE t <= 500")
def spool_budget(spark, d):
    """An entry larger than the limit is refused; what stays are the newest that fit the budget."""
    fits = spool(spark, d).where("bytes <= 90")
    return fits.join(retention.over_budget(fits, 500, "project").select("seq"), "seq", "left_anti").select("project", "seq")


@query("a69_spool_count", f"WITH {R}, {SPOOL}, o AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY seq DESC) AS n FROM s) SELECT project, seq, 'oldest' AS reason FROM o WHERE n > 10")
def spool_count(spark, d):
    return retention.over_count(spool(spark, d), 10, "project").select("project", "seq", F.lit("oldest").alias("reason"))


@query("a67_spool_queue", f"WITH {R}, {SPOOL} SELECT project, seq, bytes FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY seq DESC) AS n FROM s) WHERE n <= 10")
def spool_queue(spark, d):
    rows = spool(spark, d)
    return rows.join(retention.over_count(rows, 10, "project").select("seq"), "seq", "left_anti").select("project", "seq", "bytes")


@query("a68_replay_batch", f"WITH {R} SELECT seq FROM (SELECT seq, ts + to_seconds(least(30.0 * power(2, greatest(k % 6 - 1, 0)), 600)::BIGINT) AS next_try FROM r) WHERE next_try <= TIMESTAMP '2024-01-20' ORDER BY next_try, seq LIMIT 200")
def replay_batch(spark, d):
    wait = retention.backoff_seconds(F.col("k") % 6, 30, 600)
    rows = records(spark, d).withColumn("next_try_ts", F.timestamp_micros((F.unix_micros(F.col("ts").cast("timestamp")) + wait * 1_000_000).cast("long")))
    return retention.due_batch(rows, now(), 200).select("seq")


@query("f48_backoff", "SELECT p_partkey, least(30.0 * power(2, greatest(p_size - 1, 0)), 3600)::DOUBLE AS wait FROM part")
def backoff(spark, d):
    return table(spark, d, "part").select("p_partkey", retention.backoff_seconds(F.col("p_size"), 30, 3600).alias("wait"))


@query(
    "a66_spool_replay",
    f"WITH {R}, {SPOOL}, q AS (SELECT project, 5 + project AS room FROM (SELECT unnest(range(0, 15)) AS project)), x AS (SELECT s.*, q.room, sum(CASE WHEN q.room IS NOT NULL AND bytes <> 13 THEN 1 ELSE 0 END) OVER (PARTITION BY s.project ORDER BY seq) AS n FROM s LEFT JOIN q USING (project)) "
    "SELECT project, seq, CASE WHEN room IS NULL THEN 'unknown_project' WHEN bytes = 13 THEN 'unreadable' WHEN n <= room THEN 'admitted' ELSE 'waits' END AS outcome FROM x",
)
def spool_replay(spark, d):
    quota = spark.range(15).select(F.col("id").alias("project"), (F.col("id") + 5).alias("room"))
    return retention.admitted_replay(spool(spark, d).withColumn("readable", F.col("bytes") != 13), quota).select("project", "seq", "outcome")


@query("g18_evicted_groups", f"WITH {R}, g AS (SELECT sig, max(seq) AS last_seq, max(CASE WHEN kind = 'canary' THEN 1 ELSE 0 END) = 1 AS pinned FROM r GROUP BY 1), x AS (SELECT *, row_number() OVER (ORDER BY last_seq DESC, sig) AS n FROM g WHERE NOT pinned) SELECT sig, last_seq FROM x WHERE n > 20")
def evicted_groups(spark, d):
    stats = records(spark, d).groupBy("sig").agg(F.max("seq").alias("last_seq"), F.max(F.col("kind") == "canary").alias("pinned"))
    return retention.evicted_lru(stats, 20, F.col("pinned"), "sig").select("sig", "last_seq")


@query("g19_evicted_incidents", f"WITH {R}, {INC}, f AS ({FOLD}), x AS (SELECT inc, last_seq, row_number() OVER (ORDER BY last_seq DESC, inc) AS n FROM f WHERE NOT ({OPEN})) SELECT inc, last_seq FROM x WHERE n > 1")
def evicted_incidents(spark, d):
    return retention.evicted_lru(folded(spark, d), 1, classify.is_open(F.col("state")), "inc").select("inc", "last_seq")


# ---------------------------------------------------------------- sets
@query("h2_spine_and_aggregates", f"WITH {R} SELECT seq, kind, NULL::BIGINT AS n FROM r WHERE kind <> 'event' UNION ALL SELECT max(seq) AS seq, 'event' AS kind, count(*) AS n FROM r WHERE kind = 'event' GROUP BY sig")
def spine_and_aggregates(spark, d):
    rows = records(spark, d)
    aggregates = rows.where("kind = 'event'").groupBy("sig").agg(F.max("seq").alias("seq"), F.count("*").alias("n")).select("seq", F.lit("event").alias("kind"), "n")
    return rows.where("kind <> 'event'").select("seq", "kind").unionByName(aggregates, allowMissingColumns=True)


@query("h6_stable_dedupe", "SELECT conv_id, turn, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS words FROM (SELECT conv_id, turn, string_split(coalesce(text, ''), ' ') AS w FROM conversations)")
def stable_dedupe(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.array_distinct(F.split(F.coalesce("text", F.lit("")), " ", -1)), " ").alias("words"))


@query("h7_span_overlap", "SELECT p_partkey, (p_size < 3 AND p_size + 5 > 0) OR (p_size < 24 AND p_size + 5 > 20) OR (p_size < 60 AND p_size + 5 > 45) AS overlaps FROM part")
def span_overlap(spark, d):
    spans = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 3), (20, 24), (45, 60))))
    return table(spark, d, "part").select("p_partkey", verify.overlaps_any(F.col("p_size"), F.col("p_size") + 5, spans).alias("overlaps"))


@query("h9_unknown_keys", "SELECT event_id, array_to_string(list_filter(json_keys(props), lambda x: x NOT IN ('v', 'w')), ',') AS unknown FROM events")
def unknown_keys(spark, d):
    return table(spark, d, "events").select("event_id", F.array_join(F.array_except(F.json_object_keys("props"), F.array(F.lit("v"), F.lit("w"))), ",").alias("unknown"))
