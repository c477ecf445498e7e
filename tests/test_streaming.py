import json

from opsloom.operators import stateful
from opsloom.streaming import pipeline
from pyspark.sql import functions as F

SCHEMA = "seq long, ts timestamp, event_id string, sig string, kind string, payload string"


def drop(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def row(i, minute, event_id=None, sig="a"):
    return {"seq": i, "ts": f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z", "event_id": event_id or f"e{i}", "sig": sig, "kind": "event", "payload": "{}"}


def test_dedup_windows_and_sessions(spark, tmp_path):
    drop(tmp_path / "in", "1.json", [row(1, 0), row(2, 1, "e1"), row(3, 2), row(4, 30), row(5, 31)])
    drop(tmp_path / "in", "2.json", [row(6, 32, "e4"), row(7, 240)])
    source = lambda: pipeline.file_stream(spark, str(tmp_path / "in"), SCHEMA, 1)
    q = pipeline.start(pipeline.once_per_id(source()), str(tmp_path / "c1"), table="ids")
    q.awaitTermination(120)
    assert sorted(r.seq for r in spark.table("ids").collect()) == [1, 3, 4, 5, 7] and pipeline.progress(q)["rows"] >= 7
    q = pipeline.start(pipeline.windowed_counts(source(), "sig", "10 minutes"), str(tmp_path / "c2"), table="counts")
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("counts").collect()) == [3, 3]
    q = pipeline.start(pipeline.sessions(source(), "sig"), str(tmp_path / "c3"), table="sessions")
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("sessions").collect()) == [3, 3]


def test_ledger_sink_is_idempotent(spark, tmp_path):
    drop(tmp_path / "in", "1.json", [row(i, i) for i in range(5)] + [row(9, 1) | {"kind": "odd"}])
    drop(tmp_path / "in", "2.json", [row(i, i) for i in range(10, 13)])
    path = str(tmp_path / "log")
    dead = []
    sink = pipeline.ledger_sink(path)
    both = pipeline.split_sink(sink, lambda df, i: dead.extend(df.collect()), ~F.col("kind").isin("event"))
    stream = pipeline.file_stream(spark, str(tmp_path / "in"), SCHEMA, 1).select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), "kind", "sig", "payload")
    pipeline.start(stream, str(tmp_path / "c"), both).awaitTermination(120)
    read = lambda: sorted(r.seq for r in spark.read.json(f"{path}/records").collect())
    assert read() == list(range(1, 9)) and len(dead) == 1
    sink(spark.createDataFrame([("2024-01-01T00:00:00Z", "event", "s", "{}")], "ts string, kind string, sig string, payload string"), 0)  # a replayed batch
    assert read() == list(range(1, 9))


def test_machine_equals_batch_fold(spark, tmp_path):
    rows = [row(i, i * 3, sig="ab"[i % 2]) for i in range(30)]
    drop(tmp_path / "in", "1.json", rows[:11])
    drop(tmp_path / "in", "2.json", rows[11:])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "sig string, seq long, duplicate boolean"

    def step(state, r):
        again = "at" in state and (r["ts"] - state["at"]).total_seconds() < 600
        if not again:
            state["at"] = r["ts"]
        return [{"sig": r["sig"], "seq": r["seq"], "duplicate": again}]

    stream = pipeline.file_stream(spark, str(tmp_path / "in"), SCHEMA, 1).select("sig", "seq", "ts")
    q = pipeline.start(pipeline.machine(stream, "sig", schema, dict, step), str(tmp_path / "c"), table="machine")
    q.awaitTermination(180)
    batch = spark.read.schema(SCHEMA).json(str(tmp_path / "in")).select("sig", "seq", "ts")
    want = sorted((r.seq, r.duplicate) for r in stateful.deduplicated(batch, "sig", 600).collect())
    assert sorted((r.seq, r.duplicate) for r in spark.table("machine").collect()) == want
