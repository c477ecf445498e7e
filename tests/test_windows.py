"""Window operators that are cut into chunks or bins give what one window would."""

import datetime as dt
import random

import pytest
from opsloom.operators import desk, verify, windows
from opsloom.plans import catalog
from pyspark.sql import Window
from pyspark.sql import functions as F


def rows(spark, n=3000):
    draw = random.Random(7)
    made = [(i, draw.choice("aab"), draw.randrange(50), draw.randrange(40 * 86400)) for i in draw.sample(range(10 * n), n)]
    return spark.createDataFrame(made, "seq long, k string, v long, s long").withColumn("ts", F.timestamp_seconds("s"))


def test_running_sums_of_any_chunk(spark):
    df = rows(spark)
    want = df.withColumn("want", F.sum("v").over(Window.partitionBy("k").orderBy("seq")))
    for chunk in (1, 97, 10**9):
        assert windows.running_sum(want, F.col("v"), "k", "got", chunk).where("got <> want").count() == 0


def test_interval_joins_of_any_bin(spark):
    df = rows(spark, 400)
    w = df.select(F.col("seq").alias("wid"), "k", F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("interval 30 hours")).alias("end_ts"))
    want = {r.wid: r.n for r in w.join(df.select("k", F.col("ts").alias("t")), "k", "left").groupBy("wid").agg(F.count_if(F.expr("t between start_ts and end_ts")).alias("n")).collect()}
    for seconds in (3600, 10**7):
        assert {r.wid: r.events for r in verify.events_in(w, df, "k", bin_seconds=seconds).collect()} == want
    first = {r.wid: r.c for r in w.join(df.select("k", F.col("ts").alias("t"), "seq"), "k", "left").groupBy("wid").agg(F.min_by("seq", F.when(F.expr("t >= start_ts and t < end_ts"), F.struct("t", "seq"))).alias("c")).collect()}
    assert {r.wid: r.canary for r in verify.first_canary(w, df, "k").collect()} == first
    declared = w.where("wid % 7 = 0").select("k", F.col("start_ts").alias("from_ts"), F.col("end_ts").alias("until_ts"))
    hit = df.join(declared.select("k", "from_ts", "until_ts"), "k").where("ts >= from_ts and ts < until_ts").select("seq").distinct().count()
    for seconds in (3600, 10**7):
        assert desk.suppressed(df, declared, "k", seconds).where("suppressed").count() == hit > 0


def test_unexplained_holes_of_any_bin(spark):
    holes = spark.createDataFrame([(5, 9), (20, 20), (100, 400)], "from_seq long, to_seq long")
    spans = spark.createDataFrame([(1, 5), (7, 8), (20, 30), (90, 150), (390, 1000)], "first_seq long, last_seq long")
    for size in (1, 64, 10**6):
        assert sorted(map(tuple, verify.unexplained_holes(holes, spans, size).collect())) == [(5, 9, 2), (100, 400, 239)]


def _intervals(spark, monkeypatch):
    draw, base = random.Random(5), dt.datetime(2024, 1, 1)
    moment = lambda: base + dt.timedelta(minutes=draw.randrange(3000))
    w = [(f"w{i}", a, a + dt.timedelta(minutes=draw.choice([0, 5, 60, 300, 1500]))) for i, a in enumerate(moment() for _ in range(150))]
    g = [(f"g{i}", a, a + dt.timedelta(minutes=draw.choice([0, 1, 60, 700]))) for i, a in enumerate(moment() for _ in range(150))]
    monkeypatch.setattr(verify, "CHUNKS", (4, 8), raising=False)
    return w, g, spark.createDataFrame(w, "wid string, start_ts timestamp, end_ts timestamp"), spark.createDataFrame(g, "gid string, from_ts timestamp, to_ts timestamp")


@pytest.mark.parametrize("seconds", [600, 3600, 86_400])
def test_overlapping_deals_pairs_of_arrays(spark, monkeypatch, seconds):
    """Pairs are dealt out evenly before they are taken apart, whatever the sizes of the bins."""
    w, g, windows, gaps = _intervals(spark, monkeypatch)
    met = verify.overlapping(windows, gaps, seconds)
    got = [(r.wid, r.gid) for r in met.collect()]
    assert sorted(got) == sorted((i, j) for i, a, b in w for j, x, y in g if y >= a and x <= b)
    assert "REPARTITION_BY_NUM" in met._jdf.queryExecution().toString()


def _shuffled(spark):
    """Bytes that all stages so far have written for exchanges."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_overlapping_exchanges_rows_not_pairs(spark, monkeypatch):
    """What is exchanged follows the rows, not the pairs, and a task holds few pairs at once though a place has many."""
    monkeypatch.setattr(verify, "CHUNKS", (4, 8))
    at = F.timestamp_seconds(F.col("id") % 3000)
    windows = spark.range(1500).select(F.concat(F.lit("w"), "id").alias("wid"), at.alias("start_ts"), (at + F.expr("interval 2 days")).alias("end_ts"))
    gaps = spark.range(1500).select(F.concat(F.lit("g"), "id").alias("gid"), (at + F.expr("interval 1 hour")).alias("from_ts"), (at + F.expr("interval 2 hours")).alias("to_ts"))
    met, before = verify.overlapping(windows, gaps), _shuffled(spark)
    assert met.agg(F.count("*").alias("n"), F.count_distinct("wid", "gid").alias("m")).head()[:] == (1500**2, 1500**2)
    counted = _shuffled(spark) - before
    met.write.format("noop").mode("overwrite").save()
    assert (n := _shuffled(spark) - before - counted) < 2_000_000, n
    met.collect()
    lines = [x.strip(" :+-") for x in met._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()]
    last = next(x for x in lines if "Join" in x)
    assert last.startswith("SortMergeJoin"), last  # compiled operators begin with *(n)


def test_overlapping_as_sql_on_odd_intervals(spark):
    t = lambda h: None if h is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    ends = [(0, 5), (0, 5), (5, 0), (3, 3), (None, 4), (4, None), (-20, 900), (900, -20), (5, 6), (2, 700), (7, 7)]
    w, g = ([(None if i == 9 else i, t(a), t(b)) for i, (a, b) in enumerate(ends)] for _ in "wg")
    met = verify.overlapping(spark.createDataFrame(w, "wid long, start_ts timestamp, end_ts timestamp"), spark.createDataFrame(g, "gid long, from_ts timestamp, to_ts timestamp"), 3600)
    want = [(i, j) for i, a, b in w for j, x, y in g if None not in (a, b, x, y) and y >= a and x <= b]
    assert sorted(map(tuple, met.collect()), key=str) == sorted(want, key=str)


def test_counts_make_no_pairs(spark, monkeypatch):
    w, g, windows, gaps = _intervals(spark, monkeypatch)
    counted = verify.gaps_in(windows, gaps, 3600)
    assert {r.wid: r.gaps for r in counted.collect()} == {i: sum(y >= a and x <= b for _, x, y in g) for i, a, b in w}
    records = gaps.select(F.lit("k").alias("k"), F.col("from_ts").alias("ts"))
    keyed = windows.withColumn("k", F.when(F.col("wid") != "w3", "k"))
    at = [x for _, x, _ in g]
    for half_open, open_start in ((False, False), (True, False), (False, True)):
        found = verify.events_in(keyed, records, "k", half_open, 3600, open_start)
        inside = lambda a, b: sum((a < x if open_start else a <= x) and (x < b if half_open else x <= b) for x in at)  # noqa: B023, E731
        assert {r.wid: r.events for r in found.collect()} == {i: 0 if i == "w3" else inside(a, b) for i, a, b in w}
    plan = catalog.queries()["f44_verdicts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Join Inner" not in plan
