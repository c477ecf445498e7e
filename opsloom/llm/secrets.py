"""Secret scans (8): multipart credential linking, DataFrame and SQL functions only.

Positions come from the lengths of matches and of the gaps between them: a text is split at a
pattern, gaps and matches are exploded, and a running sum gives every start. Parts are then
joined by interval within their scope (the text, `scope` code points apart at most): running
extremes over the parts of a text in order of position, from either end, name the nearest identifier and
the nearest secret, which is the interval join without its pairs. A weak part (an account
name, a bare 40-character key, an endpoint) is reported only if its complements are in scope:
a weak secret or name needs the other one, an endpoint needs both.

Edge cases: a null text is empty; a text without parts gives one row with zeros; repeated rows
are scanned each for itself; a null doc_id is kept; overlapping weak and base parts: only the
base part is reported.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCOPE = 256
#: Of the kinds that the contract fixes.
BASE = ("assign", "access", "hex")


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    maybe: str  # a cheaper pattern that any match contains
    least: int = 0  # characters of the group below, at least
    group: int = 0
    identifies: bool = False
    secret: bool = False


#: Fixed values; base kinds first, in the order of the digest.
KINDS = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(?i)passw|secret|token|api_?key", 8, 2, secret=True),
    Kind("access", r"AKIA[A-Z0-9]+", r"AKIA", 16, 0, identifies=True),
    Kind("hex", r"[0-9a-f]{32,}+", r"[0-9a-f]{32}", 32, 0, secret=True),
    Kind("name", r"(?i:client_?id|user(?:_?name)?|login|account|tenant)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,}", r"(?i)client_?id|user|login|account|tenant", 0, 0, identifies=True),
    Kind("key", r"(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", r"[A-Za-z0-9+/]{40}", 0, 0, secret=True),
    Kind("endpoint", r"(?:https?|postgres(?:ql)?|mysql|redis|amqps?|mongodb(?:\+srv)?|s3)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+", r"://", 0, 0),
)


def _parts(text: Column, number: int, kind: Kind) -> Column:
    """array<struct<kind, i, gap, n, ok>> of one kind; gap and n are code points."""
    pattern = F.lit(kind.pattern)
    gaps = F.transform(F.split(text, kind.pattern, -1), F.length)
    matches = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    measured = F.transform(F.regexp_extract_all(text, pattern, F.lit(kind.group)), F.length) if kind.group else matches
    zipped = F.zip_with(matches, measured, lambda n, m: F.struct(n.alias("n"), (m >= kind.least).alias("ok")))
    rows = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), zipped, lambda g, z: F.struct(g.alias("gap"), z["n"].alias("n"), z["ok"].alias("ok")))
    made = F.transform(rows, lambda r, i: F.struct(F.lit(number).alias("kind"), i.alias("i"), r["gap"].alias("gap"), r["n"].alias("n"), r["ok"].alias("ok")))
    return F.when(text.rlike(kind.maybe), made).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,n:int,ok:boolean>>"))


def parts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, kind (position in KINDS), start, end, ok of every part; a row without parts has one with kind null."""
    body = F.coalesce(F.col(text), F.lit(""))
    listed = F.concat(*(_parts(F.col("t"), n, k) for n, k in enumerate(KINDS)))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), body.alias("t"))
    each = rows.select("row", "doc_id", F.explode_outer(listed).alias("p")).select("row", "doc_id", "p.*")
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("n")).over(before)
    return each.repartition("row").withColumn("end", end).select("row", "doc_id", "kind", (F.col("end") - F.col("n")).alias("start"), "end", "ok")


def spans(docs: DataFrame, scope: int = SCOPE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id and spans, array<struct<start, kind, end, partners>> ordered by start and kind, base kinds and linked weak
    ones; partners are the identifier and the secret in scope that a part is linked to."""
    of = lambda test: F.col("kind").isin([n for n, k in enumerate(KINDS) if test(k)])
    good = F.coalesce(F.col("ok"), F.lit(False))
    base, identifies, secret = good & of(lambda k: k.name in BASE), good & of(lambda k: k.identifies), good & of(lambda k: k.secret)
    # both windows grow from one row to the next, so a text of many parts costs each of them once
    forward, backward = Window.partitionBy("row").orderBy("start", "kind"), Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind"))
    earlier, later = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (forward, backward))
    place = F.struct("end", "start", "kind"), F.struct("start", "end", "kind")

    def nearest(test: Column) -> Column:
        """The part before that reaches furthest, else the next one, if it lies within the scope."""
        left, right = F.max(F.when(test, place[0])).over(earlier), F.min(F.when(test, place[1])).over(later)
        part = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))
        return F.when(left["end"] >= F.col("start") - scope, part(left)).when(right["start"] <= F.col("end") + scope, part(right))

    found = parts(docs, doc_id, text)
    covered = F.coalesce(F.max(F.when(base, F.col("end"))).over(earlier) > F.col("start"), F.lit(False)) | F.coalesce(F.min(F.when(base, F.col("start"))).over(later) < F.col("end"), F.lit(False))
    # a weak part under a base part is no complement of anything else either
    found = found.withColumn("weak", good & ~base).withColumn("covered", F.col("weak") & covered)
    live = good & ~F.col("covered")
    found = found.withColumn("id_near", nearest(live & identifies)).withColumn("secret_near", nearest(live & secret))
    has_id, has_secret = F.col("id_near").isNotNull(), F.col("secret_near").isNotNull()
    linked = F.when(base, True).when(F.col("covered"), False).when(identifies, has_secret).when(secret, has_id).otherwise(has_id & has_secret)
    partners = F.when(identifies, F.array("secret_near")).when(secret, F.array("id_near")).otherwise(F.array("id_near", "secret_near"))
    partners = F.filter(partners, lambda x: x.isNotNull())
    span = F.when(good & linked, F.struct(F.col("start").cast("long").alias("start"), "kind", F.col("end").cast("long").alias("end"), partners.alias("partners")))
    return found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span), lambda x, y: _by_place(x, y)).alias("spans"))


def _by_place(x: Column, y: Column) -> Column:
    a, b = (F.struct(z["start"], z["kind"]) for z in (x, y))
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def scan(docs: DataFrame, scope: int = SCOPE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, spans (kind:start:end, comma-joined), base (the same of the base kinds) and the counts of these."""
    names = F.array(*(F.lit(k.name) for k in KINDS))
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    count = lambda n: F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("long")
    out = spans(docs, scope, doc_id, text)
    counts = [count(n).alias(f"n_{k.name}") for n, k in enumerate(KINDS) if k.name in BASE]
    return out.select("doc_id", *counts, shown(F.filter("spans", lambda s: s["kind"] < len(BASE))).alias("base"), shown(F.col("spans")).alias("spans"))
