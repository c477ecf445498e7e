"""The record stream: schema, and the views of other tables as records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import signature as sig

KINDS = ("event", "group", "incident", "play_run", "agent_run", "tool_call", "research", "verify", "issue", "flow", "spawn", "skill", "breaker", "gap", "canary", "config", "lifecycle")
#: Of a record as it is stored; the payload stays text and is read by kind.
RECORD = (
    "seq long, rec_id string, ts string, kind string, schema_version int, sig string, inc string, origin struct<host_id:string,hub_id:string,source:string,route:string>, "
    "actor struct<kind:string,id:string,version:string,git_sha:string,build_time:string>, redactions int, payload string"
)


def of_events(events: DataFrame) -> DataFrame:
    """Records of an events table: seq, ts, kind, source, scope, sig, value, release, k."""
    kind = F.when(F.col("event_type") == "view", "canary").when(F.col("event_type") == "signup", "gap").otherwise("event")
    return events.select(
        (F.col("event_id") + 1).alias("seq"), "ts", kind.alias("kind"), F.col("event_type").alias("source"), F.col("user_id").alias("scope"),
        sig.signature("generic", "event_type", "user_id").alias("sig"), "value", F.concat(F.lit("1."), (F.col("event_id") % 7).cast("string")).alias("release"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
