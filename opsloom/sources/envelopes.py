"""Error events as clients send them: envelopes, SDK events, a generic JSON form, discard reports, log tails."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, signature, textnorm

FRAMES = "array<struct<filename:string,abs_path:string,function:string,module:string,lineno:int,in_app:boolean,context_line:string>>"
EVENT = (
    "event_id string, timestamp string, level string, logger string, culprit string, platform string, release string, environment string, message string, logentry struct<formatted:string,message:string>, "
    f"fingerprint array<string>, exception struct<values:array<struct<type:string,value:string,stacktrace:struct<frames:{FRAMES}>>>>, stacktrace struct<frames:{FRAMES}>"
)
#: What becomes of each item type; others are unknown and dropped with a count.
POLICY = {"event": "event", "client_report": "client_report", "transaction": "dropped", "session": "dropped", "sessions": "dropped", "profile": "dropped", "attachment": "binary", "replay_recording": "binary", "minidump": "binary"}


def _items(body: str | bytes, look_ahead: int = 64) -> list[dict]:
    """Items of an envelope: a header line, then item headers with bodies of a declared length or up to the next item header."""
    import json

    raw = body.encode() if isinstance(body, str) else bytes(body)
    at = raw.find(b"\n") + 1 or len(raw)
    try:
        head = json.loads(raw[:at] or b"{}")
    except ValueError:
        return [{"type": None, "body": None, "event_id": None, "error": "header"}]
    out = []
    while at < len(raw):
        end = raw.find(b"\n", at)
        end = len(raw) if end < 0 else end
        line = raw[at:end].strip()
        at = end + 1
        if not line:
            continue
        try:
            item = json.loads(line)
            kind, n = item["type"], item.get("length")
        except (ValueError, KeyError, TypeError):
            out.append({"type": None, "body": None, "event_id": head.get("event_id"), "error": "item_header"})
            break
        if isinstance(n, int):
            if at + n > len(raw):
                out.append({"type": kind, "body": None, "event_id": head.get("event_id"), "error": "short_body"})
                break
            content, at = raw[at : at + n], at + n
        else:
            stop, seen = at, 0
            while stop < len(raw) and seen < look_ahead:
                nxt = raw.find(b"\n", stop)
                nxt = len(raw) if nxt < 0 else nxt
                if seen and raw[stop:nxt].lstrip().startswith(b'{"type"'):
                    break
                stop, seen = nxt + 1, seen + 1
            content, at = raw[at:stop].rstrip(b"\n"), stop
        out.append({"type": kind, "body": content.decode("utf-8", "replace"), "event_id": head.get("event_id"), "error": None})
    return out


def items(envelopes: DataFrame, body: str = "body") -> DataFrame:
    """envelopes with one row an item: item_type, item, envelope_event_id, policy, item_error."""
    from ..shipping import ship

    ship(envelopes.sparkSession)

    @F.pandas_udf("array<struct<type:string,body:string,event_id:string,error:string>>")
    def split(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: _items(b or b""))

    x = F.col("_i")
    policy = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in POLICY.items() for v in kv]), x["type"]), F.lit("unknown"))
    each = envelopes.withColumn("_i", F.explode(split(F.col(body))))
    return each.select(*(c for c in envelopes.columns if c != body), x["type"].alias("item_type"), x["body"].alias("item"), x["event_id"].alias("envelope_event_id"), F.when(x["error"].isNull(), policy).otherwise("error").alias("policy"), x["error"].alias("item_error"))


def within_limits(packed: Column, unpacked: Column, most_packed: int = 1 << 20, most: int = 10 << 20, ratio: int = 100) -> Column:
    """Whether a compressed body may be opened: sizes and ratio."""
    return (packed <= most_packed) & (unpacked <= most) & (unpacked <= packed * ratio)


def store_body(c: Column) -> Column:
    """The body of the older single-event route: JSON, or base64 of it."""
    return F.when(F.startswith(F.ltrim(c), F.lit("{")), c).otherwise(F.try_to_binary(F.trim(c), F.lit("base64")).cast("string"))


def tags(json: Column) -> Column:
    """map<string,string> of the map form or the [{key, value}] form; sorted `k=v` texts come from sorted_tags."""
    listed = F.from_json(json, "array<struct<key:string,value:string>>")
    as_map = F.map_from_entries(F.filter(listed, lambda t: t["key"].isNotNull()))
    return F.when(F.startswith(F.ltrim(json), F.lit("[")), as_map).otherwise(F.from_json(json, "map<string,string>"))


def frame_list(json: Column) -> Column:
    """Frames of an object that lists them, or of the bare list."""
    return F.coalesce(F.from_json(F.get_json_object(json, "$.frames"), FRAMES), F.when(F.startswith(F.ltrim(json), F.lit("[")), F.from_json(json, FRAMES)), F.array().cast(FRAMES))


def text_list(json: Column) -> Column:
    """The texts of a JSON list; numbers, objects and blank texts go."""
    items = F.from_json(json, "array<variant>")
    texts = F.transform(F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))
    return F.filter(texts, lambda t: F.trim(t) != "")


def sorted_tags(t: Column) -> Column:
    return F.array_sort(F.transform(F.map_entries(t), lambda e: F.concat(e["key"], F.lit("="), e["value"])))


def events(rows: DataFrame, text: str = "item", default_id: str | None = None) -> DataFrame:
    """SDK events: id, level, message, culprit, release, frames, exception, tags, time; then signature and title."""
    e = rows.withColumn("e", F.from_json(text, EVENT))
    whole = F.get_json_object(text, "$.message.formatted")
    some = lambda c: F.nullif(c, F.lit(""))
    message = F.coalesce(some(whole), some(F.get_json_object(text, "$.message.message")), some(F.when(~F.startswith(F.coalesce(F.get_json_object(text, "$.message"), F.lit("")), F.lit("{")), F.get_json_object(text, "$.message"))), some(F.col("e.logentry.formatted")), some(F.col("e.logentry.message")))
    last = F.try_element_at(F.col("e.exception.values"), F.lit(-1))
    bare = F.element_at(F.from_json(F.get_json_object(text, "$.exception"), f"array<struct<type:string,value:string,stacktrace:struct<frames:{FRAMES}>>>"), -1)
    exception = F.coalesce(last, bare)
    frames = F.coalesce(exception["stacktrace"]["frames"], F.col("e.stacktrace.frames"))
    known = F.coalesce(some(F.col("e.event_id")), F.col(default_id)) if default_id else some(F.col("e.event_id"))
    out = e.select(
        *(c for c in rows.columns if c != text), F.lower(F.replace(known, F.lit("-"), F.lit(""))).alias("event_id"), classify.level(F.coalesce(F.col("e.level"), F.lit("error"))).alias("level"), message.alias("message"), F.col("e.culprit").alias("culprit"),
        F.col("e.release").alias("release"), F.col("e.environment").alias("env"), F.col("e.platform").alias("platform"), exception["type"].alias("exc_type"), exception["value"].alias("exc_value"), F.coalesce(frames, F.array().cast(FRAMES)).alias("frames"),
        F.col("e.fingerprint").alias("fingerprint"), tags(F.get_json_object(text, "$.tags")).alias("tags"), classify.json_time(F.col("e.timestamp")).alias("ts"),
    )
    return with_signature(out)


def with_signature(rows: DataFrame, project: Column | None = None) -> DataFrame:
    """Canonical text (a given fingerprint, else frames, else the message), signature and title."""
    project = F.lit("default") if project is None else project
    lines = textnorm.frame_lines(F.col("frames"))
    by_stack = F.concat_ws("\n", F.coalesce("exc_type", F.lit("")), textnorm.stack_text(lines))
    by_text = F.concat_ws("\n", F.coalesce("level", F.lit("")), textnorm.message_norm(F.coalesce("message", "exc_value", F.lit(""))))
    default = F.when(F.size("frames") > 0, by_stack).otherwise(by_text)
    given = textnorm.fingerprint(F.coalesce("fingerprint", F.array().cast("array<string>")), F.lit("default"))
    path = F.when(given.isNotNull(), "fingerprint").when(F.size("frames") > 0, "stack").otherwise("message")
    title = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("culprit", "message", "exc_type", "level")))
    return rows.withColumn("canonical", F.coalesce(given, default)).withColumn("canonical_from", path).withColumn("sig", signature.signature("sentinel", project, F.coalesce("culprit", F.lit("")), signature.digest(F.col("canonical")))).withColumn("title", F.substring(title, 1, 200))


#: Fields of the generic form and their limits in characters.
GENERIC = {"event_id": 64, "message": 8192, "level": 16, "culprit": 512, "logger": 256, "platform": 64, "release": 256, "env": 64, "timestamp": 64, "exception": None, "fingerprint": None, "tags": None, "extra": None}


def generic_events(rows: DataFrame, text: str = "value") -> DataFrame:
    """Events of the closed generic form; `causes` names unknown and oversize fields and what is missing."""
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    unknown = F.transform(F.filter(keys, lambda k: ~k.isin(*GENERIC)), lambda k: F.concat(F.lit("unknown:"), k))
    get = lambda k: F.get_json_object(text, f"$.{k}")
    long_ones = F.array_compact(F.array(*(F.when(F.length(get(k)) > n, F.lit(f"too_long:{k}")) for k, n in GENERIC.items() if n)))
    missing = F.array_compact(F.array(F.when(F.json_object_keys(text).isNull(), "not_an_object"), F.when(get("message").isNull() & get("exception").isNull(), "empty")))
    stack = F.from_json(F.get_json_object(text, "$.exception.stack"), "array<struct<file:string,function:string,line:int,in_app:boolean,context_line:string>>")
    frames = F.transform(stack, lambda f: F.struct(f["file"].alias("filename"), f["file"].alias("abs_path"), f["function"].alias("function"), F.lit("").alias("module"), f["line"].alias("lineno"), f["in_app"].alias("in_app"), f["context_line"].alias("context_line")))
    out = rows.select(
        *(c for c in rows.columns if c != text), get("event_id").alias("event_id"), classify.level(F.coalesce(get("level"), F.lit("error"))).alias("level"), get("message").alias("message"), get("culprit").alias("culprit"), get("release").alias("release"), get("env").alias("env"), get("platform").alias("platform"),
        F.get_json_object(text, "$.exception.type").alias("exc_type"), F.get_json_object(text, "$.exception.value").alias("exc_value"), F.coalesce(frames, F.array().cast(FRAMES)).alias("frames"), F.from_json(get("fingerprint"), "array<string>").alias("fingerprint"), tags(get("tags")).alias("tags"),
        classify.json_time(get("timestamp")).alias("ts"), F.concat(missing, unknown, long_ones).alias("causes"),
    )
    return with_signature(out)


def discards(rows: DataFrame, text: str = "item") -> DataFrame:
    """Rows of a client report: reason, category, quantity."""
    body = F.from_json(text, "timestamp string, discarded_events array<struct<reason:string,category:string,quantity:int>>")
    each = rows.withColumn("_b", body).select(*(c for c in rows.columns if c != text), classify.json_time(F.col("_b.timestamp")).alias("reported"), F.explode("_b.discarded_events").alias("_d"))
    return each.select(*(c for c in each.columns if c != "_d"), "_d.reason", "_d.category", "_d.quantity")


def queue_entries(rows: DataFrame, text: str = "value", version: int = 1, most_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(entries that can be appended, dead letters with their cause) of queued envelopes."""
    e = rows.withColumn("e", F.from_json(text, "v int, key string, body string"))
    cause = F.when(F.col("e.key").isNull() | F.col("e.body").isNull(), "undecodable").when(F.col("e.v") != version, "version").when(F.octet_length(text) > most_bytes, "size")
    marked = e.withColumn("cause", cause)
    return marked.where("cause is null").select("e.key", "e.body"), marked.where("cause is not null").select(F.col(text).alias("entry"), "cause")
