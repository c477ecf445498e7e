"""Stateful operators against plain sequential versions, on random sequences of a fixed seed and shuffled inputs."""

import random
from datetime import datetime, timedelta

from opsloom.functions import parsers
from opsloom.operators import stateful as s
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)


def stream(spark, n=600, keys=4, seed=20260916, scale=40):
    draw, now, rows = random.Random(seed), T0, []
    for i in range(n):
        now += timedelta(seconds=draw.choice([0, 1, 1, 2, scale, scale * 5]) if draw.random() > 0.02 else 4000)
        rows.append((i, now, f"k{draw.randrange(keys)}"))
    return rows, spark.createDataFrame(rows, "seq long, ts timestamp, sig string").repartition(7)


def test_fold_windows_begin_at_their_first_row(spark):
    rows, df = stream(spark)
    want, open_ = [], {}
    for seq, ts, sig in rows:
        f = open_.get(sig)
        if f and ts >= f[1] + timedelta(seconds=300):
            want.append((sig, *f))
            f = None
        open_[sig] = (f[0], f[1], ts, f[3] + 1) if f else (seq, ts, ts, 1)
    want += [(k, *f) for k, f in open_.items()]
    assert sorted(tuple(r) for r in s.folded(df).collect()) == sorted(want)


def test_dedup_cooldown_and_bucket(spark):
    rows, df = stream(spark)
    seen, dup, fired, level = {}, [], [], {}
    admitted = []
    for seq, ts, sig in rows:
        again = sig in seen and ts < seen[sig] + timedelta(seconds=60)
        if not again:
            seen[sig] = ts
            fired.append(seq)
        dup.append((seq, again))
        at, have = level.get(sig, (ts, 3.0))
        have = min(3.0, have + (ts - at).total_seconds() * 2 / 60)
        admitted.append((seq, have >= 1))
        level[sig] = (ts, have - (have >= 1))
    assert sorted((r.seq, r.duplicate) for r in s.deduplicated(df, "sig", 60).collect()) == dup
    assert sorted(r.seq for r in s.cooled(df, 60, ["sig"]).collect()) == fired
    assert sorted((r.seq, r.admitted) for r in s.token_bucket(df, 2, 3, "sig").collect()) == admitted


def test_caps(spark):
    rows, df = stream(spark)
    caps, made, want = [("hour", 3600, 4), ("day", 86400, 30)], {}, []
    for seq, ts, sig in rows:
        mine = made.setdefault(sig, [])
        broken = next((n for n, sec, most in caps if sum(t > ts - timedelta(seconds=sec) for t in mine) >= most), None)
        if broken is None:
            mine.append(ts)
        want.append((seq, broken))
    assert sorted((r.seq, r.violated) for r in s.create_caps(df, caps, "sig").collect()) == want


def test_breaker_opens_probes_and_doubles(spark):
    at = lambda sec: T0 + timedelta(seconds=sec)
    b, c = s.Breaker(cap=1, sustain=0), s.Circuit()
    moves = [(0, 0), (1, 1), (60, 2), (61, 2), (61, 3)]
    got = []
    for sec, rate in moves:
        c, allowed, probe = b.decide(c, at(sec), rate)
        got.append((allowed, probe, c.phase))
    assert got == [(True, False, "closed"), (False, False, "open"), (False, False, "open"), (True, True, "half_open"), (False, True, "half_open")]
    c = b.verdict(c, at(62), 4)
    assert c.phase == "open" and c.until == at(62 + 120) and c.trips == 2
    c, *_ = b.decide(c, at(182), 0)
    c = b.verdict(c, at(182), 0)
    assert c.phase == "closed" and b.wait(c) == 60
    waits = []
    for _ in range(8):
        c = b.tripped(c, at(0))
        waits.append((c.until - T0).total_seconds())
    assert waits == [120, 240, 480, 960, 1800, 1800, 1800, 1800]


def test_breaker_against_a_plain_one(spark):
    """Phases told from the times of trips alone, without remembering a state."""
    rows, df = stream(spark, n=900, scale=7)
    want, kept = {}, {}
    for seq, ts, sig in rows:
        k = kept.setdefault(sig, {"all": [], "since": None, "open_until": None, "exp": None, "trips": 0})
        rate = sum(ts - timedelta(seconds=60) < t <= ts for t in k["all"])
        k["all"].append(ts)
        trip = False
        if k["open_until"] is not None:
            if ts < k["open_until"]:
                want[seq] = (False, False, "open", k["trips"])
                continue
            trip, answer = sum(ts - timedelta(seconds=60) < t < ts for t in k["all"]) >= 2, (True, True)
            k["open_until"], k["since"] = None, None
            if not trip:
                k["exp"] = 0
        elif rate < 2:
            k["since"], answer = None, (True, False)
        else:
            k["since"] = k["since"] or ts
            trip, answer = ts - k["since"] >= timedelta(seconds=30), (False, False)
        if trip:
            k["exp"] = 0 if k["exp"] is None else k["exp"] + 1
            k["trips"] += 1
            k["open_until"] = ts + timedelta(seconds=min(20 * 2 ** k["exp"], 100))
        want[seq] = (*answer, "open" if trip else "closed", k["trips"])
    got = {r.seq: (r.allowed, r.probe, r.state, r.trips) for r in s.breaker(df, 2, "sig", sustain=30, base=20, longest=100).collect()}
    assert got == want and max(t for *_, t in want.values()) >= 3


def test_arrivals_merge(spark):
    at = lambda sec: T0 + timedelta(seconds=sec)
    rows = [
        ("u", 1, at(0), "properties_changed", "failed", None), ("u", 2, at(2), "job_removed", None, "failed"), ("u", 3, at(3), "journald", None, None), ("u", 4, at(60), "properties_changed", "auto-restart", None),
        ("u", 5, at(90), "properties_changed", "failed", None), ("u", 6, at(2000), "properties_changed", "failed", None), ("v", 7, at(0), "journald", None, None), ("v", 8, at(1), "reconcile", "failed", None),
        ("v", 9, at(50), "resolved", None, None), ("v", 10, at(100), "reconcile", "failed", None), ("v", 11, at(120), "resolved", None, None), ("v", 12, at(9000), "reconcile", "failed", None),
    ]
    df = spark.createDataFrame(rows, "unit string, seq long, ts timestamp, path string, substate string, job_result string").repartition(5)
    got = {r.seq: (r.outcome, r["class"], r.n) for r in s.merged_arrivals(df).collect()}
    assert got == {
        1: ("opened", "failed", 1), 2: ("attached", "job:failed", 2), 3: ("attached", "job:failed", 3), 4: ("counted", "crash_loop", 4), 5: ("absorbed", "crash_loop", 5), 6: ("opened", "failed", 1),
        7: ("alone", "", 0), 8: ("opened", "failed", 1), 9: ("resolved", "failed", 1), 10: ("reopened", "failed", 2), 11: ("resolved", "failed", 2), 12: ("opened", "failed", 1),
    }


def test_admission(spark):
    rows = [("a", 1, T0, "e1", "s1", False, False), ("a", 2, T0, "e1", "s1", False, False), ("a", 3, T0, "e2", "s1", False, False), ("a", 4, T0, "e3", "s2", False, False), ("a", 5, T0, "e4", "s2", True, False)]
    rows += [("a", 6, T0, "r", "", False, True), ("a", 7, T0 + timedelta(hours=1), "e5", "s2", False, False), ("a", 8, T0 + timedelta(hours=1), "r", "", False, True), ("a", 9, T0 + timedelta(hours=99), "e6", "s2", False, False)]
    df = spark.createDataFrame(rows, "key string, seq long, ts timestamp, event_id string, sig string, suppressed boolean, resolves boolean")
    got = [(r.outcome, r.incident) for r in s.admitted(df, 86400).orderBy("seq").collect()]
    assert got == [("created", "a/1"), ("duplicate", "a/1"), ("folded", "a/1"), ("merged", "a/1"), ("suppressed", "a/1"), ("resolved", "a/1"), ("reopened", "a/1"), ("resolved", "a/1"), ("created", "a/2")]


def test_transitions(spark):
    moves = ["observation_admitted", "rung_advance_play", "run_started_check", "nope", "apply_decision", "applied_run_complete", "window_passed", "human_ack", "recurrence_after_resolve", "nope", "human_ack"]
    got = s.transitions(spark.createDataFrame([("i", n, m) for n, m in enumerate(moves)], "inc string, seq long, trigger string")).orderBy("seq").collect()
    assert [r.edge for r in got] == ["T01", "T03", "T08", None, "T10", "T12", "T38", None, "T42", "T47", None]
    assert got[-1].to_state == "quarantined" and len(s.EDGES) == 50 and s.legal_edges(spark).count() == 45 + 2 + 11 + 19 + 16 + 2 + 1


def test_blocks_and_parsers(spark):
    go = ["panic: boom", "", "goroutine 1 [running]:", "main.work(0x1)", "\t/app/main.go:12 +0x1", "runtime.main()", "\t/usr/local/go/src/runtime/proc.go:250 +0x2"]
    py = ["Traceback (most recent call last):", '  File "/app/x.py", line 3, in f', "    g()", '  File "/usr/lib/python3/site-packages/y.py", line 9, in g', "ValueError: bad"]
    lines = [("go", i, T0, x) for i, x in enumerate(["hello", *go, "bye"])] + [("py", i, T0, x) for i, x in enumerate([*py, "next"])]
    df = spark.createDataFrame(lines, "source string, line_no long, ts timestamp, text string").repartition(3)
    got = s.assembled(df.where("source = 'go'"), *parsers.BLOCKS["go-panic"]).select(parsers.go_panic(F.col("text")).alias("p"), "lines").first()
    assert got.lines == 7 and got.p.title == "boom" and [(f.filename, f.function, f.in_app) for f in got.p.frames] == [("/app/main.go", "main.work", True), ("/usr/local/go/src/runtime/proc.go", "runtime.main", False)]
    got = s.assembled(df.where("source = 'py'"), *parsers.BLOCKS["py-traceback"]).select(parsers.py_traceback(F.col("text")).alias("p"), "lines").first()
    assert got.lines == 5 and got.p.title == "ValueError: bad" and [(f.lineno, f.in_app) for f in got.p.frames] == [(3, True), (9, False)]
