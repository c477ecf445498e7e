"""Host observations: pressure files, journal lines, mounts, timers, sockets, file events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, signature, textnorm

JOURNAL = "__CURSOR string, MESSAGE string, _SYSTEMD_UNIT string, SYSLOG_IDENTIFIER string, _COMM string, PRIORITY string, _PID string, __REALTIME_TIMESTAMP string"


def pressure(text: Column) -> Column:
    """struct of some and full averages and totals of a pressure file; what isn't in it is null."""

    def part(line: str, name: str, kind: str) -> Column:
        return F.nullif(F.regexp_extract(text, rf"(?m)^{line} .*?\b{name}=([0-9.]+)", 1), F.lit("")).try_cast(kind).alias(f"{line}_{name}")

    return F.struct(*(part(line, name, "long" if name == "total" else "double") for line in ("some", "full") for name in ("avg10", "avg60", "avg300", "total")))


def pressure_samples(files: DataFrame) -> DataFrame:
    """Observations of (scope, ts, text): averages, bucket and signature."""
    p = files.withColumn("p", pressure(F.col("text"))).select("scope", "ts", "p.*")
    return p.withColumn("bucket", classify.pressure_bucket(F.col("some_avg10"))).withColumn("sig", signature.signature("psi", "scope", F.lit("some"), "bucket"))


def journal(raw: DataFrame, text: str = "value", most_bytes: int = 65_536) -> DataFrame:
    """Entries of journal JSON lines: unit, message (a text or an array of bytes), severity, signature; one row a cursor."""
    j = raw.select(F.col(text).alias("_t"), F.from_json(text, JOURNAL).alias("j"), F.from_json(F.get_json_object(text, "$.MESSAGE"), "array<int>").alias("b"))
    octets = F.decode(F.unhex(F.array_join(F.transform("b", lambda x: F.lpad(F.hex(x), 2, "0")), "")), "UTF-8")
    message = F.coalesce(F.when(F.size("b") > 0, octets), F.col("j.MESSAGE"), F.lit(""))
    priority = F.coalesce(F.col("j.PRIORITY").try_cast("int"), F.lit(6))
    unit = F.coalesce(*(F.nullif(F.col(f"j.{c}"), F.lit("")) for c in ("_SYSTEMD_UNIT", "SYSLOG_IDENTIFIER", "_COMM")), F.lit("unknown"))
    rows = j.where(F.col("j.__CURSOR").isNotNull()).select(
        F.col("j.__CURSOR").alias("cursor"), F.timestamp_micros(F.col("j.__REALTIME_TIMESTAMP").try_cast("long")).alias("ts"), unit.alias("unit"), textnorm.byte_cut(message, most_bytes).alias("message"), (F.octet_length(message) > most_bytes).alias("truncated"), priority.alias("priority"),
    )
    rows = rows.withColumn("norm", textnorm.message_norm("message")).withColumn("masked", textnorm.mask_message("message")).withColumn("severity", classify.severity_of_priority(F.col("priority"))).withColumn("priority_name", classify.priority_name(F.col("priority")))
    return rows.withColumn("sig", signature.signature("journald", "unit", "norm")).dropDuplicates(["cursor"])


def mounts(lines: DataFrame, text: str = "value") -> DataFrame:
    """device, mount, fstype of a mount table; octal escapes are undone for blanks."""
    p = F.split(text, " ")
    return lines.where(F.size(p) >= 3).select(p[0].alias("device"), F.replace(p[1], F.lit("\\040"), F.lit(" ")).alias("mount"), p[2].alias("fstype"))


def disk(samples: DataFrame) -> DataFrame:
    """free_pct and inode_free_pct of (mount, blocks, free, files, files_free); -1 where a file system has no inodes."""
    share = lambda a, b: F.round(100.0 * F.col(a) / F.col(b), 4)
    return samples.withColumn("free_pct", F.when(F.col("blocks") > 0, share("free", "blocks")).otherwise(-1.0)).withColumn("inode_free_pct", F.when(F.col("files") > 0, share("files_free", "files")).otherwise(-1.0))


def missed_timers(samples: DataFrame) -> DataFrame:
    """Missed runs in a row of (timer, ts, next_elapse): the time of the last sample has passed and nothing moved."""
    order = Window.partitionBy("timer").orderBy("ts")
    before = F.lag("next_elapse").over(order)
    missed = F.coalesce((before == F.col("next_elapse")) & (F.col("next_elapse") < F.col("ts")), F.lit(False))
    runs = samples.withColumn("missed", missed).withColumn("_run", F.sum((~F.col("missed")).cast("int")).over(order))
    count = F.sum(F.col("missed").cast("int")).over(Window.partitionBy("timer", "_run").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("missed_runs", count).withColumn("bucket", classify.missed_bucket(F.col("missed_runs"))).withColumn("interval_s", F.unix_timestamp("next_elapse") - F.unix_timestamp(before)).drop("_run")


def file_events(events: DataFrame) -> DataFrame:
    """Class of (path, mask) file events and their signature."""
    has = lambda bit: F.col("mask").bitwiseAND(bit) > 0
    kind = F.when(has(0x4000), "overflow").when(has(0x2 | 0x8), "modify").when(has(0x100 | 0x80), "create").when(has(0x200 | 0x40 | 0x400), "delete").when(has(0x4), "attrib").otherwise("other")
    return events.withColumn("class", kind).withColumn("sig", signature.signature("inotify", "path", "class"))


def sockets(lines: DataFrame, text: str = "value") -> DataFrame:
    """proto, address, port, state and inode of socket table lines (IPv4)."""
    p = F.split(F.trim(F.regexp_replace(text, " +", " ")), " ")
    local = F.split(p[1], ":")
    octet = lambda i: F.conv(F.substring(local[0], 7 - 2 * i, 2), 16, 10)
    states = ["?", "ESTABLISHED", "SYN_SENT", "SYN_RECV", "FIN_WAIT1", "FIN_WAIT2", "TIME_WAIT", "CLOSE", "CLOSE_WAIT", "LAST_ACK", "LISTEN", "CLOSING"]
    state = F.element_at(F.array(*map(F.lit, states)), F.conv(p[3], 16, 10).cast("int") + 1)
    return lines.where(F.col(text).rlike(r"^\s*\d+: [0-9A-F]{8}:[0-9A-F]{4}")).select("proto", F.concat_ws(".", *(octet(i) for i in range(4))).alias("address"), F.conv(local[1], 16, 10).cast("int").alias("port"), state.alias("state"), p[9].try_cast("long").alias("inode"))


def socket_owners(socks: DataFrame, owners: DataFrame, units: DataFrame) -> DataFrame:
    """Sockets with the lowest pid that holds their inode, and its unit."""
    first = owners.groupBy("inode").agg(F.min("pid").alias("pid"))
    return socks.join(first, "inode", "left").join(units, "pid", "left")


def processes(lines: DataFrame, page: int, text: str = "value") -> DataFrame:
    """pid, comm, state, ppid, ticks and rss of process status lines; a name may hold blanks and brackets, so what follows begins at the last one."""
    head, rest = F.regexp_extract(text, r"^(\d+) \((.*)\) ", 1), F.split(F.regexp_extract(text, r"^\d+ \(.*\) (.*)\z", 1), " ")
    at = lambda i: F.get(rest, F.lit(i))
    whole = lambda i: at(i).try_cast("long")
    return lines.where(head != "").select(head.cast("long").alias("pid"), F.regexp_extract(text, r"^\d+ \((.*)\) ", 1).alias("comm"), at(0).alias("state"), whole(1).alias("ppid"), (whole(11) + whole(12)).alias("ticks"), (whole(21) * page).alias("rss"))
