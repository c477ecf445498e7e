import json

import pytest
from opsloom.sources import envelopes, ledger, observations
from pyspark.sql import functions as F


def rec(seq, **more):
    return json.dumps({"seq": seq, "ts": f"2024-01-0{1 + seq // 10}T00:00:{seq % 60:02d}.000Z", "kind": "event", "schema_version": 1, "sig": "s", "payload": "{}"} | more)


@pytest.fixture
def log(tmp_path):
    a = [rec(1), rec(2) + rec(3), "", '{"seq": 4, "ki', "garbage", rec(5, schema_version=2), rec(6, kind="nope"), rec(7)]
    (tmp_path / "2024-01-01.g0.p0001.jsonl").write_text("\n".join(a))
    (tmp_path / "2024-01-02.g0.p0001.jsonl").write_text("\n".join([rec(11), rec(12)]))
    (tmp_path / "2024-01-02.g1.p0001.jsonl").write_text(rec(11))
    return str(tmp_path)


def test_log_states_and_authority(spark, log):
    assert sorted(r.seq for r in ledger.read(spark, log).collect()) == [1, 2, 3, 7, 11]
    first = ledger.scan_report(spark, log).where("file like '2024-01-01%'").first()
    assert (first.ok, first.torn, first.corrupt, first.newer, first.first_seq, first.last_seq) == (4, 1, 2, 1, 1, 7)
    some, partial = ledger.capped(ledger.read(spark, log), 3)
    assert some.count() == 3 and partial


def test_append_and_archive(spark, tmp_path):
    drafts = spark.createDataFrame([("2024-01-01T00:00:00Z", "event", "s", json.dumps({"op": "x", "text": "y" * n})) for n in (1, 5000, 300_000)] + [("2024-01-01T00:00:00Z", "event", "", "{}"), ("2024-01-02T00:00:00Z", "odd", "s", "{}")], "ts string, kind string, sig string, payload string").repartition(3)
    path = str(tmp_path / "log")
    assert ledger.append(drafts, path, 10) == 13 and ledger.append(drafts, path, 13) == 16
    rows = spark.read.json(path)
    assert sorted(r.seq for r in rows.collect()) == list(range(11, 17))
    assert rows.where("payload_hash is not null").count() == 4 and rows.where(F.get_json_object("payload", "$.truncated") == "true").count() == 2
    assert ledger.archived(rows, str(tmp_path / "arch")).first().verified
    ledger.to_columnar(spark.createDataFrame([(1, "2024-01-01 00:00:00")], "seq long, ts string").withColumn("ts", F.to_timestamp("ts")), str(tmp_path / "col"))
    assert spark.read.parquet(str(tmp_path / "col")).where("day = '2024-01-01' and seq = 1").count() == 1


def test_observations(spark):
    text = "some avg10=41.70 avg60=1.00 avg300=0.10 total=123\nfull avg10=2.00 avg60=0.50 avg300=0.00 total=9\n"
    rows = observations.pressure_samples(spark.createDataFrame([("io", None, text), ("cpu", None, text.split("\n")[0])], "scope string, ts timestamp, text string")).orderBy("scope").collect()
    assert rows[0].full_avg10 is None and rows[1].full_total == 9 and rows[1].bucket == "b3"
    lines = [{"__CURSOR": "c1", "MESSAGE": "retry 12", "_SYSTEMD_UNIT": "a.service", "PRIORITY": "3", "__REALTIME_TIMESTAMP": "1704067200000000"}, {"__CURSOR": "c1", "MESSAGE": "dup"}, {"__CURSOR": "c2", "MESSAGE": [104, 195, 169], "_COMM": "x"}]
    got = {r.cursor: r for r in observations.journal(spark.createDataFrame([(json.dumps(x),) for x in lines[::2]], "value string")).collect()}
    assert got["c1"].norm == "retry #" and got["c1"].severity == "high" and got["c2"].message == "hé" and got["c2"].unit == "x"
    assert observations.journal(spark.createDataFrame([(json.dumps(x),) for x in lines], "value string")).count() == 2
    disk = observations.disk(spark.createDataFrame([("/", 100, 5, 0, 0)], "mount string, blocks long, free long, files long, files_free long")).first()
    assert disk.free_pct == 5.0 and disk.inode_free_pct == -1.0
    socks = observations.sockets(spark.createDataFrame([("tcp", "   0: 0100007F:1F90 00000000:0000 0A 00000000:00000000 00:00000000 00000000  1000        0 4321 1")], "proto string, value string")).first()
    assert (socks.address, socks.port, socks.state, socks.inode) == ("127.0.0.1", 8080, "LISTEN", 4321)
    timers = spark.createDataFrame([("t", f"2024-01-01 00:0{m}:00", f"2024-01-01 00:0{n}:00") for m, n in ((0, 1), (2, 1), (3, 1), (4, 5))], "timer string, ts string, next_elapse string").select("timer", F.to_timestamp("ts").alias("ts"), F.to_timestamp("next_elapse").alias("next_elapse"))
    assert [r.missed_runs for r in observations.missed_timers(timers).orderBy("ts").collect()] == [0, 1, 2, 0]


def test_envelopes(spark):
    event = {"event_id": "A" * 32, "level": "FATAL", "timestamp": 1704067200.5, "message": {"formatted": "boom 7"}, "tags": [["x", "y"]] and [{"key": "k", "value": "v"}], "exception": {"values": [{"type": "E", "value": "v", "stacktrace": {"frames": [{"filename": "/a/b.py", "function": "f", "lineno": 3, "in_app": True}]}}]}}
    body = json.dumps(event)
    report = json.dumps({"timestamp": "2024-01-01T00:00:00Z", "discarded_events": [{"reason": "rate", "category": "error", "quantity": 3}]})
    envelope = "\n".join([json.dumps({"event_id": "b" * 32}), json.dumps({"type": "event", "length": len(body)}), body, json.dumps({"type": "client_report"}), report, json.dumps({"type": "session"}), "{}"])
    rows = envelopes.items(spark.createDataFrame([(1, envelope), (2, "nope"), (3, '{}\n{"type":"event","length":99}\n{}')], "id int, body string"))
    assert [(r.id, r.policy, r.item_error) for r in rows.orderBy("id", "policy").collect()] == [(1, "client_report", None), (1, "dropped", None), (1, "event", None), (2, "error", "header"), (3, "error", "short_body")]
    e = envelopes.events(rows.where("policy = 'event'"), default_id="envelope_event_id").first()
    assert (e.event_id, e.level, e.message, e.exc_type, e.tags, e.canonical_from, e.title) == ("a" * 32, "fatal", "boom 7", "E", {"k": "v"}, "stack", "boom 7")
    assert e.canonical == "E\napp|b|f|b.py|LINE|"
    assert [(d.reason, d.quantity) for d in envelopes.discards(rows.where("policy = 'client_report'")).collect()] == [("rate", 3)]
    generic = [json.dumps({"message": "m", "odd": 1, "level": "x" * 20}), "[]", json.dumps({"exception": {"type": "T", "value": "v", "stack": [{"file": "/x/y.go", "function": "g", "line": 1, "in_app": False}]}, "fingerprint": ["{{ default }}", "z"]})]
    got = envelopes.generic_events(spark.createDataFrame([(i, g) for i, g in enumerate(generic)], "id int, value string")).orderBy("id").collect()
    assert [r.causes for r in got] == [["unknown:odd", "too_long:level"], ["not_an_object", "empty"], []] and got[2].canonical == "default\nz"
    good, dead = envelopes.queue_entries(spark.createDataFrame([('{"v":1,"key":"k","body":"b"}',), ('{"v":2,"key":"k","body":"b"}',), ("x",)], "value string"))
    assert good.count() == 1 and sorted(r.cause for r in dead.collect()) == ["undecodable", "version"]
