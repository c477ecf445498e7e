"""Structured Streaming: the same operators over a stream of records.

A micro-batch is the unit of commit: its records get contiguous seqs, are appended and only then acknowledged by the
checkpoint, and a batch id that was appended before is skipped, so a replay changes nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..sources import ledger


def file_stream(spark: SparkSession, path: str, schema: str | StructType, files_per_batch: int = 100, form: str = "json") -> DataFrame:
    """A folder that files are dropped into, read at a bounded rate."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form).load(path)


def tail_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Lines of log files with the file they come from; the checkpoint holds the offsets."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"))


def once_per_id(events: DataFrame, key: str = "event_id", ts: str = "ts", within: str = "10 minutes") -> DataFrame:
    """Events whose id wasn't seen within the time; state older than it is dropped."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, by: str, window: str = "1 minute", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Counts of each window, given out when the watermark has passed it."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def sessions(events: DataFrame, by: str, gap: str = "5 minutes", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Runs of events no further apart than the gap."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def latest_before(events: DataFrame, canaries: DataFrame, key: str, within: str = "15 minutes") -> DataFrame:
    """Stream-stream join: events with the canaries of their key from the time before them."""
    a = events.withWatermark("ts", within).alias("a")
    b = canaries.select(F.col(key).alias("c_key"), F.col("ts").alias("c_ts"), F.col("seq").alias("canary")).withWatermark("c_ts", within).alias("b")
    return a.join(b, F.expr(f"c_key = {key} and c_ts <= ts and c_ts >= ts - interval {within}"), "leftOuter")


class Machine(StatefulProcessor):
    """A step function of operators.stateful over a stream: the state of a key is a pickled object in the state store.

    `timeout` seconds of silence finish a key (processing time)."""

    def __init__(self, start: Callable[[], object], step: Callable[[object, dict], list[dict]], finish: Callable[[object], list[dict]] | None = None, timeout: float | None = None, order: str = "seq"):
        self.start, self.step, self.finish, self.timeout, self.order = start, step, finish, timeout, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "raw binary")

    def _load(self):
        import pickle

        held = self.state.get()
        return pickle.loads(bytes(held[0])) if held is not None else self.start()

    def handleInputRows(self, key, rows, timerValues):
        import pickle

        import pandas as pd

        state, out = self._load(), []
        for pdf in rows:
            for row in pdf.sort_values(self.order).to_dict("records"):
                out += self.step(state, {k: v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for k, v in row.items()})
        self.state.update((pickle.dumps(state),))
        if self.timeout is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.timeout * 1000))
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        out = self.finish(self._load()) if self.finish else []
        self.state.clear()
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def machine(events: DataFrame, key: str, schema: str, start, step, finish=None, timeout: float | None = None, order: str = "seq") -> DataFrame:
    """events through a step function by key; needs the RocksDB state store."""
    from ..shipping import ship

    ship(events.sparkSession)
    return events.groupBy(key).transformWithStateInPandas(Machine(start, step, finish, timeout, order), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if timeout is not None else "None")


def split_sink(good: Callable[[DataFrame, int], None], bad: Callable[[DataFrame, int], None], is_bad) -> Callable[[DataFrame, int], None]:
    """foreachBatch: rows that can't be appended go to the dead letters, with the rest untouched."""

    def run(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            good(held.where(~is_bad), batch_id)
            bad(held.where(is_bad), batch_id)
        finally:
            held.unpersist()

    return run


def ledger_sink(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch: append a batch of drafts with the seqs after the last one; a batch that is already there is skipped.

    Batches are numbered upwards, so the last commit is all that has to be kept: it says which batches are there and where seqs go on."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        hadoop = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        commits = hadoop(f"{path}/commits")
        fs = commits.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [int(s.getPath().getName()) for s in fs.listStatus(commits)] if fs.exists(commits) else []
        done = [n for n in names if fs.exists(hadoop(f"{path}/commits/{n}/_SUCCESS"))]
        if done and batch_id <= max(done):
            return
        last = spark.read.schema("last_seq long").json(f"{path}/commits/{max(done)}").first()[0] if done else 0
        part = f"{path}/records/batch={batch_id}"
        fs.delete(hadoop(part), True)  # halves of an attempt that didn't commit
        end = ledger.append(batch, part, last)
        spark.createDataFrame([(end,)], "last_seq long").coalesce(1).write.mode("overwrite").json(f"{path}/commits/{batch_id}")
        for n in names:
            if n != batch_id:
                fs.delete(hadoop(f"{path}/commits/{n}"), True)

    return run


def start(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None, table: str | None = None, mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Start a query into a foreachBatch sink or a memory table; without `every` it takes what is there and ends."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(sink) if sink else writer.format("memory").queryName(table or f"t{uuid.uuid4().hex}")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def progress(query: StreamingQuery) -> dict:
    """Rows and rates of the last batches."""
    recent = query.recentProgress
    return {"batches": len(recent), "rows": sum(p["numInputRows"] for p in recent), "last_batch": recent[-1]["batchId"] if recent else None}
