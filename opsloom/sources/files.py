"""Files of boards, corpora, skills and spools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_each(rows: DataFrame, path: str, suffix: str) -> None:
    """(class, file, value): a folder for every class and file, with one text in it."""
    rows.select("class", F.concat("file", F.lit(f".{suffix}")).alias("file"), "value").write.partitionBy("class", "file").option("lineSep", "\x00").text(path)


def board(spark: SparkSession, path: str) -> DataFrame:
    """rows, last_id and the style of the ids of a board of JSON lines: what stands before their number."""
    rows = spark.read.schema("id string, title string").json(path)
    number = F.regexp_extract("id", r"(\d+)\z", 1).try_cast("long")
    style = F.regexp_extract("id", r"^(.*?)\d*\z", 1)
    return rows.agg(F.count("*").alias("rows"), F.max(number).alias("last_id"), F.max_by(style, number).alias("style"))


def corpus(spark: SparkSession, path: str, glob: str, most_files: int, most_bytes: int) -> DataFrame:
    """Files below a folder whose name fits the pattern: class, file, modified, length, text; the newest of them, up to a number, none larger than the limit."""
    name = "/class=([^/]*)/file=([^/]*)/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    of = lambda i: F.regexp_extract("path", name, i)
    pattern = "^" + glob.replace(".", r"\.").replace("*", ".*") + r"\z"
    rows = found.select(of(1).alias("class"), of(2).alias("file"), F.col("modificationTime").alias("modified"), F.rtrim(F.decode("content", "UTF-8"), F.lit("\x00")).alias("text")).withColumn("length", F.octet_length("text"))
    return rows.where(F.col("file").rlike(pattern) & (F.col("length") <= most_bytes)).orderBy(F.col("modified").desc(), "class", "file").limit(most_files)


def skills(spark: SparkSession, path: str, most_bytes: int, most: int = 10_000) -> DataFrame:
    """name and why a skill folder is refused, null if it isn't: a SKILL.md needs a front matter and a bounded size."""
    rows = corpus(spark, path, "SKILL.md", most, 1 << 30)
    refused = F.when(~F.startswith("text", F.lit("---\n")), "no_front_matter").when(F.col("length") > most_bytes, "too_large")
    return rows.select(F.col("class").alias("name"), refused.alias("refused"))


def _checksum(entry: Column) -> Column:
    """Independent of the order in which a segment's lines are read."""
    return F.sum(F.crc32(entry.cast("binary")).cast("decimal(38,0)")).cast("string")


def seal_segments(entries: DataFrame, path: str) -> None:
    """(segment, seq, entry): entries by segment, and a footer for each with its number of entries and their checksum."""
    entries.write.partitionBy("segment").json(f"{path}/entries")
    entries.groupBy("segment").agg(F.count("*").alias("count"), _checksum(F.col("entry")).alias("checksum")).write.json(f"{path}/footers")


def read_segments(spark: SparkSession, path: str, tamper: Column | None = None) -> DataFrame:
    """segment, entries and whether they are intact: as many as the footer says, with its checksum. `tamper` changes entries, for tests."""
    rows = spark.read.schema("segment long, seq long, entry string").json(f"{path}/entries")
    if tamper is not None:
        rows = rows.withColumn("entry", F.when(tamper, F.concat("entry", F.lit(" "))).otherwise(F.col("entry")))
    found = rows.groupBy("segment").agg(F.count("*").alias("entries"), _checksum(F.col("entry")).alias("now"))
    footers = spark.read.schema("segment long, count long, checksum string").json(f"{path}/footers")
    intact = F.col("entries").eqNullSafe(F.col("count")) & F.col("now").eqNullSafe(F.col("checksum"))
    return footers.join(found, "segment", "left").select("segment", F.coalesce("entries", F.lit(0).cast("long")).alias("entries"), intact.alias("intact"))


def flat_config(texts: DataFrame) -> DataFrame:
    """file, key, value of INI and ENV texts (file, text): `section.key`, with comments and blank lines left out and quotes taken off."""
    lines = texts.select("file", F.posexplode(F.split("text", r"\r?\n", -1)).alias("n", "line")).withColumn("line", F.trim("line"))
    section = F.nullif(F.regexp_extract("line", r"^\[([^\]]+)\]\z", 1), F.lit(""))
    order = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("section", F.last(section, ignorenulls=True).over(order)).where(F.col("line").rlike(r"^[^#;\[][^=]*="))
    key = F.trim(F.regexp_replace(F.substring_index("line", "=", 1), "^export ", ""))
    value = F.trim(F.regexp_extract("line", "^[^=]*=(.*)", 1))
    return placed.select("file", F.concat_ws(".", "section", key).alias("key"), F.regexp_replace(value, "^([\"'])(.*)\\1\\z", "$2").alias("value"))
