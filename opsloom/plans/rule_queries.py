"""Queries of the rule language, one for each of its parts, and of predicates on records and processes."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import classify
from ..operators import incidents
from . import predicate
from .catalog import query, table
from .stream_queries import FOLD, INC, R, folded, records


def holds(spark, d, text, **more):
    """Seqs of the records for which an expression is true."""
    named = {"value": F.col("value"), "source": F.col("source"), "count": F.col("k").cast("double"), "enabled": F.col("k") % 2 == 0, "msg": F.concat(F.col("source"), F.lit(" of "), F.col("scope").cast("string"))}
    return records(spark, d).where(predicate.compile_predicate(text, None, named, **more)).select("seq")


@query("b2_tokens", f"WITH {R} SELECT seq FROM r WHERE source = 'error' AND value >= -1.5 AND k <= 90 AND source || ' of ' || scope <> 'a ''b'''")
def tokens(spark, d):
    return holds(spark, d, "source == \"error\"and(value>=-1.5) and\n count <= 90 and msg != 'a \\'b\\''")


@query("b3_or", f"WITH {R} SELECT seq FROM r WHERE value > 40 OR source = 'click' OR k = 3")
def either(spark, d):
    return holds(spark, d, 'value > 40 or source == "click" or count == 3')


@query("b4_and", f"WITH {R} SELECT seq FROM r WHERE (value > 10 OR k > 50) AND source = 'view' AND k < 95")
def both(spark, d):
    return holds(spark, d, '(value > 10 or count > 50) and source == "view" and count < 95')


@query("b5_not", f"WITH {R} SELECT seq FROM r WHERE source <> 'click' AND value > 5 AND k <> 7")
def negated(spark, d):
    return holds(spark, d, 'not (source == "click") and not not (value > 5) and not (count == 7)')


@query("b6_bare_bool", f"WITH {R} SELECT seq FROM r WHERE k % 2 = 0 AND value > 3")
def bare_bool(spark, d):
    return holds(spark, d, "enabled and value > 3")


@query("b7_lists", f"WITH {R} SELECT seq FROM r WHERE source IN ('click', 'view') AND k IN (1, 2, 3, 50)")
def lists(spark, d):
    return holds(spark, d, 'source in ["click", "view"] and (count in [1, 2, 3, 50] or count in [])')


@query("b10_equality", f"WITH {R} SELECT seq FROM r WHERE k = 30 OR source = 'error' AND k <> 31")
def equality(spark, d):
    return holds(spark, d, 'count == 30 or source == "error" and count != 31 or source == "30"')


@query("b17_rule_columns", f"WITH {R} SELECT seq, value >= 20 AND source = 'error' AND regexp_matches(release, '^1[.][0-3]$') AS matches FROM r")
def rule_columns(spark, d):
    rule = predicate.Rule("x", "sentinel", (predicate.Condition("value", ">=", "20", "number"), predicate.Condition("source", "==", "error"), predicate.Condition("release", "~", "^1[.][0-3]$")))
    return records(spark, d).select("seq", rule.column({"value": F.col("value"), "source": F.col("source"), "release": F.col("release")}).alias("matches"))


@query("b18_when_clauses", f"WITH {R} SELECT seq FROM r WHERE value > 30")
def when_clauses(spark, d):
    """Names that a play doesn't know are missing, so what compares with them is false."""
    return holds(spark, d, 'value > 30 or unheard_of == 3 or other_flag or third != "x"', open_names=True)


@query("b19_bound_names", f"WITH {R} SELECT seq FROM r WHERE k % 3 <> 0 AND value < 25 AND source = 'click'")
def bound_names(spark, d):
    """Names bound from a map of texts: what isn't a number there is missing."""
    detail = F.create_map(F.lit("free_pct"), F.when(F.col("k") % 3 == 0, "n/a").otherwise(F.col("value").cast("string")), F.lit("mount"), F.col("source"))
    rows = records(spark, d).withColumn("detail", detail)
    return rows.where(predicate.compile_predicate('free_pct < 25 and mount == "click"', "disk", predicate.bound("detail", "disk", {}))).select("seq")


def said(spark, rows, names):
    return spark.createDataFrame(rows, names)


#: Expressions and whether they are refused.
TEXTS = [
    ("value > 3", "psi", False), ('value > "3"', "psi", True), ('release > "1.0"', "sentinel", True), ("value", "psi", True), ('scope in ["a", 1]', "psi", True), ('msg ~ "(unclosed"', "psi", True), ('msg ~ "' + "x" * 513 + '"', "psi", True),
    ("free_pct < 5", "disk", False), ("free_pct < 5", "psi", True), ("missed_runs >= 2 and not enabled", "timers", False), ("value > 3 and", "psi", True), ("not (enabled)", "psi", False),
]


def _refused(text, source):
    try:
        predicate.parse(text, source)
    except predicate.PredicateError:
        return True
    return False


def _values(rows):
    quote = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(quote(v) for v in row) + ")" for row in rows)


@query("b8_type_checks", f"SELECT * FROM (VALUES {_values(TEXTS)}) AS v(text, source, refused)")
def type_checks(spark, d):
    return said(spark, [(t, s, _refused(t, s)) for t, s, _ in TEXTS], "text string, source string, refused boolean")


#: (source, name, known)
NAMES = [("psi", "some_avg10", True), ("psi", "free_pct", False), ("disk", "free_pct", True), ("disk", "value", True), ("timers", "missed_runs", True), ("timers", "path", False), ("inotify", "path", True), ("sentinel", "level", True), ("dbus", "unit_substate", True), ("journald", "priority", True), ("journald", "mount", False)]


@query("b12_namespaces", f"SELECT * FROM (VALUES {_values(NAMES)}) AS v(source, name, known)")
def namespaces(spark, d):
    return said(spark, [(s, n, n in predicate.COMMON | predicate.FIELDS[s]) for s, n, _ in NAMES], "source string, name string, known boolean")


@query("b14_rule_validation", "SELECT * FROM (VALUES ('good', 0), ('same names', 1), ('long cooldown', 1), ('unknown source', 1), ('no condition', 2), ('too many', 1)) AS v(rules, problems)")
def rule_validation(spark, d):
    c = (predicate.Condition("free_pct", "<", "5", "number"),)
    rule = lambda n, **more: predicate.Rule(n, more.pop("source", "disk"), more.pop("match", c), **more)
    sets = {
        "good": [rule("a"), rule("b")], "same names": [rule("a"), rule("a")], "long cooldown": [rule("a", cooldown="25h")], "unknown source": [rule("a", source="moon")], "no condition": [rule("a", match=())],
        "too many": [rule(f"r{i}") for i in range(257)],
    }
    return said(spark, [(n, len(predicate.validate(r))) for n, r in sets.items()], "rules string, problems int")


@query("b15_inferred_scopes", "SELECT * FROM (VALUES ('full', 'io,memory'), ('some', 'cpu,io,memory'), ('own', 'cpu'), ('disk', '')) AS v(name, scopes)")
def inferred_scopes(spark, d):
    c = lambda f: (predicate.Condition(f, ">", "5", "number"),)
    rules = [predicate.Rule("full", "psi", c("full_avg10")), predicate.Rule("some", "psi", c("some_avg10")), predicate.Rule("own", "psi", c("some_avg10"), scopes=("cpu",)), predicate.Rule("disk", "disk", c("free_pct"))]
    return said(spark, [(r.name, ",".join(r.inferred_scopes())) for r in rules], "name string, scopes string")


@query("b16_fingerprints", "SELECT n_nationkey, substr(sha256('disk' || chr(31) || '1m' || chr(31) || 'free_pct' || chr(30) || '<' || chr(30) || n_nationkey || chr(30) || 'number'), 1, 16) AS fingerprint FROM nation")
def fingerprints(spark, d):
    keys = range(table(spark, d, "nation").count())  # a rule for each nation: rules live on the driver
    rule = lambda k: predicate.Rule(f"r{k}", "disk", (predicate.Condition("free_pct", "<", str(k), "number"),), hold="1m")
    return said(spark, [(k, rule(k).fingerprint()) for k in keys], "n_nationkey int, fingerprint string")


LITERALS = [("count", "==", "5", "number", "count == 5"), ("msg", "==", 'a "b"', "string", 'msg == "a \\"b\\""'), ("enabled", "==", "true", "bool", "enabled == true"), ("scope", "in", "[io, 'memory']", "string", 'scope in ["io", "memory"]'), ("count", "in", "1,2", "number", "count in [1, 2]")]


@query("b33_rule_literals", f"SELECT text FROM (VALUES {_values(LITERALS)}) AS v(field, op, value, type, text)")
def rule_literals(spark, d):
    return said(spark, [(predicate.Condition(*c[:4]).text(),) for c in LITERALS], "text string")


@query("b34_in_lists", f"WITH {R} SELECT seq FROM r WHERE source IN ('click', 'view')")
def in_lists(spark, d):
    rule = predicate.Rule("x", "sentinel", (predicate.Condition("source", "in", " [click, 'view' ,\"nobody\"] "),))
    return records(spark, d).where(rule.column({"source": F.col("source")})).select("seq")


# ---------------------------------------------------------------- markers, processes, projections
def payloads(spark, d):
    k = F.col("k")
    op = classify.chosen(k % 4, [(0, "compaction_marker"), (1, "compaction_aggregate")], "other")
    return records(spark, d).select("seq", F.to_json(F.struct(op.alias("op"), F.when(k % 5 == 0, True).alias("aggregate"))).alias("payload"))


@query("b23_compaction_markers", f"WITH {R} SELECT seq FROM r WHERE k % 4 = 1")
def compaction_markers(spark, d):
    return payloads(spark, d).where(incidents.is_compaction(F.col("payload"))).select("seq")


@query("b24_aggregates", f"WITH {R} SELECT seq FROM r WHERE k % 4 = 1 OR k % 5 = 0")
def aggregates(spark, d):
    return payloads(spark, d).where(incidents.is_compaction(F.col("payload"), broad=True)).select("seq")


@query("b29_process_filters", "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#1%' AND p_size BETWEEN 5 AND 40 AND p_type IN ('ECONOMY', 'PROMO')")
def process_filters(spark, d):
    rows = table(spark, d, "part").withColumnsRenamed({"p_brand": "unit", "p_size": "pid", "p_type": "state"})
    return incidents.filtered(rows, {"unit": "Brand#1%", "pid": (5, 40), "state": ("ECONOMY", "PROMO")}).select("p_partkey")


@query("b30_protected_paths", "SELECT p_partkey, p_size % 4 = 0 OR p_size % 4 = 1 AS protected FROM part")
def protected_paths(spark, d):
    n = F.col("p_size").cast("string")
    path = classify.chosen(F.col("p_size") % 4, [(0, "/etc/ssh")], None)
    path = F.when(F.col("p_size") % 4 == 1, F.concat(F.lit("/etc/ssh/"), n)).when(F.col("p_size") % 4 == 2, F.concat(F.lit("/etc/sshd"), n)).when(F.col("p_size") % 4 == 3, "/srv/x").otherwise(path)
    return table(spark, d, "part").select("p_partkey", incidents.is_protected(path, ("/etc/ssh", "/boot")).alias("protected"))


@query("b31_incident_rows", f"WITH {R}, {INC}, f AS ({FOLD}) SELECT inc, coalesce(state, '') AS state, coalesce(severity, '') AS severity, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(updated_ts)) // 60000000 AS age_minutes, coalesce(state, '') NOT IN ('resolved', 'suppressed', 'quarantined', '') AS open FROM f")
def incident_view(spark, d):
    return incidents.view(folded(spark, d), F.lit("2024-02-01").cast("timestamp"))


@query("a56_rule_files", "SELECT * FROM (VALUES ('low', 'disk'), ('stall', 'psi')) AS v(name, source)")
def rule_files(spark, d):
    """Rules of TOML files: a directory is taken as a whole."""
    import tempfile
    from pathlib import Path

    with tempfile.TemporaryDirectory() as folder:
        (Path(folder) / "a.toml").write_text('[[rule]]\nname="low"\nsource="disk"\n[[rule.match]]\nfield="free_pct"\nop="<"\nvalue=5\nvalue_type="number"\n')
        (Path(folder) / "b.toml").write_text('[[rule]]\nname="stall"\nsource="psi"\nfor="2m"\n[[rule.match]]\nfield="some_avg10"\nop=">"\nvalue=20\nvalue_type="number"\n')
        rules = predicate.load_rules(folder)
    return said(spark, [(r.name, r.source) for r in rules], "name string, source string")
