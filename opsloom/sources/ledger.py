"""The record log as files of JSON lines: reading with every kind of damage accounted for, appending, compaction of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stream import KINDS, RECORD

SCHEMA_VERSION = 1
#: File names are day, generation and part: 2024-01-02.g3.p0001.jsonl
NAME = r"(\d{4}-\d{2}-\d{2})\.g(\d+)\.p(\d+)\.jsonl"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, day, generation, part, line_no and text of every line."""
    raw = spark.read.text(path).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"))
    part = lambda i: F.regexp_extract("file", NAME, i)
    return raw.select("file", part(1).alias("day"), part(2).try_cast("int").alias("generation"), part(3).try_cast("int").alias("part"), "line_no", "text")


def authoritative(files: DataFrame) -> DataFrame:
    """Lines of the newest generation of each day; it supersedes the day's other files."""
    newest = files.groupBy("day").agg(F.max("generation").alias("generation"))
    return files.join(F.broadcast(newest), ["day", "generation"], "left_semi")


def torn(text: Column) -> Column:
    """A line that begins a record and doesn't end it."""
    return F.startswith(F.trim(text), F.lit("{")) & ~F.endswith(F.trim(text), F.lit("}"))


def unglued(text: Column) -> Column:
    """array<string>: records that a crash wrote onto one line, each on its own."""
    return F.split(F.regexp_replace(text, r"\}\s*(?=\{\"seq\":)", "}\n"), "\n")


def named(text: Column) -> Column:
    """The seq that a line begins with, of a torn line too; null where its digits may have been torn."""
    return F.regexp_extract(text, r"^\s*\{\s*\"seq\"\s*:\s*(\d+)\s*,", 1).try_cast("long")


def decoded(rows: DataFrame, schema: str = RECORD) -> DataFrame:
    """rows with `r`, the decoded record, and `state`: ok, blank, torn, corrupt or newer (a schema that isn't known yet)."""
    each = rows.withColumn("text", F.explode(unglued(F.col("text")))).withColumn("r", F.from_json("text", schema))
    state = (
        F.when(F.trim("text") == "", "blank").when(torn(F.col("text")), "torn").when(F.col("r.seq").isNull() | ~F.coalesce(F.col("r.kind").isin(*KINDS), F.lit(False)), "corrupt")
        .when(F.coalesce(F.col("r.schema_version"), F.lit(1)) > SCHEMA_VERSION, "newer").otherwise("ok")
    )
    return each.withColumn("state", state)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the authoritative files; ts also as a timestamp."""
    good = decoded(authoritative(lines(spark, path))).where("state = 'ok'").select("r.*", "day")
    return good.withColumn("ts_raw", F.col("ts")).withColumn("ts", F.col("ts").try_cast("timestamp"))


def scan_report(spark: SparkSession, path: str) -> DataFrame:
    """Per file: lines of each state, seq range and time range."""
    rows = decoded(lines(spark, path))
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    ok = F.when(F.col("state") == "ok", F.col("r.seq"))
    return rows.groupBy(F.regexp_extract("file", NAME, 0).alias("file")).agg(*map(count, ("ok", "torn", "corrupt", "newer", "blank")), F.min(ok).alias("first_seq"), F.max(ok).alias("last_seq"), F.min(F.when(F.col("state") == "ok", F.col("r.ts"))).alias("min_ts"), F.max(F.when(F.col("state") == "ok", F.col("r.ts"))).alias("max_ts"))


def recovered(spark: SparkSession, path: str, hint: int) -> DataFrame:
    """What a start has to know: the last seq of the authoritative files, at least the hint, and how many superseded files go."""
    all_lines = lines(spark, path)
    kept = authoritative(all_lines)
    last = decoded(kept).where("state = 'ok'").agg(F.max("r.seq").alias("seq"))
    count = lambda df, n: df.agg(F.count_distinct(F.regexp_extract("file", NAME, 0)).alias(n))
    return last.crossJoin(count(all_lines, "a")).crossJoin(count(kept, "b")).select(F.greatest("seq", F.lit(hint).cast("long")).alias("last_seq"), (F.col("a") - F.col("b")).alias("dropped"))


def capped(records: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The first records of a scan with a cap, and whether some were left out."""
    some = records.limit(most)
    return some, records.limit(most + 1).count() > most


def prepared(drafts: DataFrame, most_bytes: int = 262_144, kept: tuple[str, ...] = ("op", "digest", "merge_key", "subject", "title", "group_id", "incident_id")) -> DataFrame:
    """Drafts as they are appended: invalid ones named, oversize payloads cut down to reserved members, long ones with a hash."""
    from ..functions.signature import payload_hash

    needs_sig = F.col("kind").isin("event", "incident", "verify", "play_run")
    error = F.when(~F.col("kind").isin(*KINDS), "kind").when(needs_sig & (F.coalesce("sig", F.lit("")) == ""), "sig").when(F.get_json_object("payload", "$").isNull(), "payload")
    big = F.octet_length("payload") > most_bytes
    small = F.to_json(F.struct(F.lit(True).alias("truncated"), F.octet_length("payload").alias("size"), *(F.get_json_object("payload", f"$.{k}").alias(k) for k in kept)))
    return drafts.withColumn("error", error).withColumn("payload_hash", payload_hash("payload")).withColumn("payload", F.when(big, small).otherwise(F.col("payload")))


def append(drafts: DataFrame, path: str, after_seq: int, generation: int = 0) -> int:
    """Append valid drafts with contiguous seqs from after_seq + 1 on, as JSON lines by day; the last seq.

    The drafts are written to a staging folder first, so that counting and numbering see the same rows whatever made them. Seqs come
    from the counts of its files, so the batch needs no single sorted partition."""
    from ..shipping import ship
    from .scratch import folder

    spark = drafts.sparkSession
    ship(spark)
    stage = folder(spark, "append")
    prepared(drafts).where("error is null").drop("error").write.parquet(stage)
    good = spark.read.parquet(stage).select("*", F.col("_metadata.file_name").alias("_p"), F.monotonically_increasing_id().alias("_i"))
    counts = dict(good.groupBy("_p").count().collect())
    base, total = {}, after_seq
    for p in sorted(counts):
        base[p], total = total, total + counts[p]
    if counts:
        start = F.element_at(F.create_map(*[F.lit(x) for kv in base.items() for x in kv]), F.col("_p"))
        seq = (start + F.row_number().over(Window.partitionBy("_p").orderBy("_i"))).cast("long")
        out = good.withColumn("seq", seq).withColumn("schema_version", F.lit(SCHEMA_VERSION)).withColumn("day", F.substring("ts", 1, 10)).drop("_p", "_i")
        out.write.mode("append").partitionBy("day").json(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stage)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return total


def to_columnar(records: DataFrame, path: str, max_records: int = 1_000_000) -> None:
    """Records as Parquet by day, sorted by seq within files so that row groups prune by it."""
    day = F.date_format("ts", "yyyy-MM-dd")
    rows = records.withColumn("day", day).repartition("day").sortWithinPartitions("day", "seq")
    rows.write.mode("overwrite").option("maxRecordsPerFile", max_records).partitionBy("day").parquet(path)


def archived(records: DataFrame, path: str) -> DataFrame:
    """Write a generation, read it back and compare: one row with records, checksum and verified."""
    def total(df: DataFrame) -> DataFrame:
        line = F.to_json(F.struct(*sorted(records.columns)))
        return df.agg(F.count("*").alias("records"), F.sum(F.xxhash64(line).cast("decimal(38,0)")).cast("string").alias("checksum"))

    records.write.mode("overwrite").parquet(path)
    back = records.sparkSession.read.schema(records.schema).parquet(path)
    a, b = total(records), total(back).select(F.col("records").alias("r"), F.col("checksum").alias("c"))
    return a.crossJoin(b).select("records", "checksum", (F.col("records").eqNullSafe(F.col("r")) & F.col("checksum").eqNullSafe(F.col("c"))).alias("verified"))
