"""Issues, skills, research and board rows: caps, gates, holds, grants, validity joins, status lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def suppressed(observations: DataFrame, declared: DataFrame, key: str = "scope", bin_seconds: int = 21_600) -> DataFrame:
    """observations with `suppressed`: inside an interval [from_ts, until_ts) declared for their key. A semi join in bins of time, so
    overlapping intervals don't multiply rows and a busy key is spread."""
    n = lambda c: F.floor(F.unix_timestamp(c) / bin_seconds)
    d = declared.select(F.col(key).alias("_k"), "from_ts", "until_ts", F.explode(F.sequence(n(F.col("from_ts")), n(F.col("until_ts")))).alias("_d"))
    o = observations.withColumn("_bin", n(F.col("ts")))
    hit = o.join(d, (o[key] == d["_k"]) & (o["_bin"] == d["_d"]) & (F.col("ts") >= F.col("from_ts")) & (F.col("ts") < F.col("until_ts")), "left_semi").select("seq", F.lit(True).alias("_hit"))
    return observations.join(hit, "seq", "left").withColumn("suppressed", F.coalesce("_hit", F.lit(False))).drop("_hit")


def elapsed_suppression(declared: DataFrame, arrivals: DataFrame, verdicts: DataFrame) -> DataFrame:
    """What follows a window that is over: recorded if anything arrived under it, resolved if its verdict passed, else kept."""
    n = arrivals.where("suppressed").groupBy("scope").agg(F.count("*").alias("n"))
    joined = declared.join(n, "scope", "left").join(verdicts, "scope", "left")
    return joined.select("scope", F.when(F.coalesce("n", F.lit(0)) > 0, "recorded").when(F.col("verdict") == "passed", "resolved").otherwise("suppressed").alias("state"))


def recurrences(records: DataFrame, seconds: int, key: str = "sig") -> DataFrame:
    """records with `recurrence`: the first of its key or later than the dedup window after the one before; others fold."""
    order = Window.partitionBy(key).orderBy("ts", "seq")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(order)
    return records.withColumn("recurrence", F.coalesce(gap > seconds * 1_000_000, F.lit(True)))


def quiet_gates(issues: DataFrame, quiet_seconds: int, as_of: Column) -> DataFrame:
    """Issues with the five gates of a quiet close and whether all are open: quiet, resolved, canary seen, no gap, not kept by hand."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    gates = F.array(us(as_of) - us(F.col("last_ts")) >= quiet_seconds * 1_000_000, F.col("state") == "resolved", F.col("canary_seen"), F.col("gaps") == 0, ~F.col("manual"))
    names = F.array(*map(F.lit, ("quiet", "resolved", "canary", "complete", "automatic")))
    held = F.filter(F.arrays_zip(names.alias("n"), gates.alias("g")), lambda x: ~F.coalesce(x["g"], F.lit(False)))
    return issues.withColumn("blocked_by", F.transform(held, lambda x: x["n"])).withColumn("close", F.forall(gates, lambda g: F.coalesce(g, F.lit(False))))


def strikes(records: DataFrame, days: int, most: int, key: str = "sig") -> DataFrame:
    """Failures with which a key has `most` or more in the trailing days."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    frame = Window.partitionBy(key).orderBy(us).rangeBetween(-(days * 86_400_000_000 - 1), 0)
    return records.withColumn("strikes", F.count("*").over(frame)).where(F.col("strikes") >= most)


def regressions(events: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Events whose release orders after the one their incident was resolved in, of (sig, seq, release) and (sig, resolved_release)."""
    from ..functions.classify import compare_releases

    return events.join(resolutions, "sig").where(compare_releases("release", "resolved_release") > 0).select("sig", "seq", "release", "resolved_release")


def releases_in_order(records: DataFrame) -> DataFrame:
    """Releases with the number of other releases that order before them, and their first observation; newest first by both."""
    from ..functions.classify import compare_releases

    seen = records.groupBy("release").agg(F.min("seq").alias("first_seq"))
    other = seen.select(F.col("release").alias("o"))
    pairs = seen.join(other, F.col("release") != F.col("o"), "left")  # the releases of a project, not its records
    return pairs.groupBy("release", "first_seq").agg(F.count_if(compare_releases("release", "o") > 0).alias("after")).orderBy(F.col("after").desc(), F.col("first_seq").desc())


def held_skills(skills: DataFrame, windows: DataFrame) -> DataFrame:
    """Skills that an open, unpassed verify window of one of their signatures blocks."""
    open_ = windows.where("not passed").select("sig").distinct()
    each = skills.select("name", "version", F.explode("sigs").alias("sig"))
    return each.join(open_, "sig", "left_semi").select("name", "version").distinct()


def canary_green(skills: DataFrame, canaries: DataFrame, host: str, as_of: Column, validity_seconds: int) -> DataFrame:
    """skills with `green`: their newest canary on the host succeeded and is still valid."""
    newest = canaries.where(F.col("host") == host).groupBy("name", "version").agg(F.max_by(F.struct("ok", "ts"), "ts").alias("c"))
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    fresh = us(F.col("c.ts")) >= us(as_of) - validity_seconds * 1_000_000
    return skills.join(newest, ["name", "version"], "left").withColumn("green", F.coalesce(F.col("c.ok") & fresh, F.lit(False))).drop("c")


def granted(calls: DataFrame, grants: DataFrame) -> DataFrame:
    """calls with the grant of `rule|module|16 hex of sig`, else of `rule|module`."""
    exact = grants.select(F.col("key").alias("k1"), F.col("grant").alias("g1"))
    wide = grants.select(F.col("key").alias("k2"), F.col("grant").alias("g2"))
    base = F.concat_ws("|", "rule", "module")
    named = calls.withColumn("k1", F.concat_ws("|", base, F.substring(F.substring_index("sig", ":", -1), 1, 16))).withColumn("k2", base)
    return named.join(exact, "k1", "left").join(wide, "k2", "left").withColumn("grant", F.coalesce("g1", "g2")).drop("k1", "k2", "g1", "g2")


def project_of_key(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """requests with their project, or why there is none: unknown or expired key."""
    joined = requests.join(keys, "key", "left")
    expired = F.col("valid_until").isNotNull() & (F.col("valid_until") <= F.col("ts"))
    return joined.withColumn("error", F.when(F.col("project").isNull(), "unknown_key").when(expired, "expired_key")).withColumn("project", F.when(F.col("error").isNull(), F.col("project")))


def status_line(rows: DataFrame, by: str) -> DataFrame:
    """One text: `state=n` of every state, in order."""
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    return counts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "n"))), lambda x: F.concat(x[by], F.lit("="), x["n"].cast("string"))), " ").alias("line"))


def newest_answer(answers: DataFrame) -> DataFrame:
    """Per question the answer of a primary file before others, then of the newest file."""
    return answers.groupBy("question").agg(F.min_by("answer", F.struct(~F.col("primary"), -F.unix_micros(F.col("mtime").cast("timestamp")), F.col("answer"))).alias("answer"))


def highest_tag(tags: DataFrame, name: str = "name") -> DataFrame:
    """The tag of the highest version; tags that are no versions don't count."""
    from ..functions.classify import semver

    return tags.withColumn("_v", semver(name)).where("_v is not null").agg(F.max_by(name, "_v").alias("tag"))


def story(records: DataFrame, most: int = 200) -> DataFrame:
    """Per incident the last value of each kind among its newest records."""
    place = F.row_number().over(Window.partitionBy("inc").orderBy(F.col("seq").desc()))
    few = records.withColumn("_n", place).where(F.col("_n") <= most)
    return few.groupBy("inc", "kind").agg(F.max_by("value", "seq").alias("value"), F.count("*").alias("n"))


def steps(incidents: DataFrame, stamps: dict[str, str]) -> DataFrame:
    """Timeline steps of an incident, one row each that has happened: inc, step, ts, place."""
    each = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).alias("step"), F.col(c).alias("ts")) for i, (n, c) in enumerate(stamps.items())))
    rows = incidents.select("inc", F.explode(F.filter(each, lambda s: s["ts"].isNotNull())).alias("s")).select("inc", "s.*")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("inc").orderBy("ts", "i"))).drop("i")


def summary(columns: list[str], most: int = 200) -> Column:
    """The first non-empty columns, at most three, in one line."""
    some = F.filter(F.array(*(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns)), lambda x: x != "")
    return F.substring(F.array_join(F.slice(some, 1, 3), " · "), 1, most)


def best_answer(json: Column) -> Column:
    """The first acceptable answer of an array, an object with `answers`, or a bare object: one with a non-empty text."""
    items = "array<struct<text:string>>"
    inner = F.get_json_object(json, "$.answers")
    listed = F.when(F.startswith(F.ltrim(json), F.lit("[")), F.from_json(json, items)).when(inner.isNotNull(), F.from_json(inner, items)).otherwise(F.array(F.from_json(json, "struct<text:string>")))
    return F.get(F.filter(listed, lambda a: F.coalesce(F.trim(a["text"]), F.lit("")) != ""), F.lit(0))["text"]


def issue_body(title: str, rows: list[tuple[str, str]], evidence: str, sig: str = "sig", most: int = 60_000) -> Column:
    """Issue text: a marker, a title, a table and fenced evidence; too long, the evidence is cut in its middle."""
    head = F.concat_ws("\n", F.concat(F.lit("<!-- sig: "), F.col(sig), F.lit(" -->")), F.concat(F.lit("## "), F.col(title)), F.lit("| field | value |"), F.lit("|---|---|"), *(F.concat(F.lit(f"| {n} | "), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(" |")) for n, c in rows))
    room = F.greatest(F.lit(most) - F.length(head) - 16, F.lit(0))
    text = F.col(evidence)
    half = F.floor((room - 5) / 2).cast("int")
    cut = F.when(F.length(text) <= room, text).otherwise(F.concat(F.substring(text, F.lit(1), half), F.lit("\n...\n"), F.substring(text, F.length(text) - half + 1, half)))
    return F.concat(head, F.lit("\n```\n"), cut, F.lit("\n```\n"))


def source_label(sig: Column) -> Column:
    """Label of a signature's source."""
    source = F.regexp_extract(sig, "^([a-z]+):", 1)
    return F.when(source == "", "source:unknown").otherwise(F.concat(F.lit("source:"), source))


def merge_subject(payload: Column, ordered: list[tuple[str, str]], sig: Column) -> Column:
    """payload.subject, else the first listed member that the payload has (with the subject listed for it), else the signature's digest."""
    get = lambda k: F.nullif(F.get_json_object(payload, f"$.{k}"), F.lit(""))
    listed = [F.when(get(k).isNotNull(), F.lit(s) if s else get(k)) for k, s in ordered]
    return F.coalesce(get("subject"), *listed, F.substring_index(sig, ":", -1))
