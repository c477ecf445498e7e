"""Closed classifications: levels, buckets, classes, ranks, zones, versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .signature import _text, trimmed

LEVELS = ("debug", "info", "warning", "error", "fatal", "critical")
#: Ordered patterns of problem classes; the first that is found wins.
TAXONOMY = [
    ("resource_exhaustion", r"(?i)\boom\b|out of memory|cannot allocate memory|memory cgroup|pressure (full|some)|no space left|disk full"),
    ("crash_loop", r"(?i)start request repeated too quickly|start-limit-hit|restart(ed|ing)? (loop|too quickly)|panic:|fatal:|segmentation fault"),
    ("permission_denied", r"(?i)permission denied|eacces|eperm|auth_admin|polkit"),
    ("network_timeout", r"(?i)connection refused|timed out|timeout|etimedout|dial tcp|no route to host"),
    ("config_error", r"(?i)no such file|unknown field|invalid (config|yaml|json)|parse error|unmarshal"),
    ("queue_wedge", r"(?i)deadlock|queue (wedge|full)|pool exhausted|backpressure|blocked on"),
    ("data_corruption", r"(?i)corrupt|checksum mismatch|bad magic|torn|truncated"),
    ("dependency_failure", r"(?i)module not found|cannot find module|importerror|dependency"),
]


def chosen(c: Column, cases: list[tuple[object, object]], otherwise: object) -> Column:
    """Equality cases in order."""
    out = F.lit(otherwise)
    for value, result in reversed(cases):
        out = F.when(c.isin(*value) if isinstance(value, tuple) else c == value, F.lit(result)).otherwise(out)
    return out


def stepped(c: Column, limits: list[tuple[float, object]], otherwise: object, strict: bool = True) -> Column:
    """The result of the first limit that c lies below (or, not strict, doesn't exceed)."""
    out = F.lit(otherwise)
    for limit, result in reversed(limits):
        out = F.when(c < limit if strict else c <= limit, F.lit(result)).otherwise(out)
    return out


def level(c: Column | str) -> Column:
    low = F.lower(trimmed(c))
    return F.when(low.isin(*LEVELS), low).otherwise("error")


def pressure_bucket(c: Column) -> Column:
    return stepped(c, [(10.0, "b1"), (25.0, "b2"), (50.0, "b3")], "b4")


def missed_bucket(c: Column) -> Column:
    return stepped(c, [(0, "0"), (1, "1"), (4, "2-4"), (9, "5-9")], "10+", strict=False)


def priority_name(c: Column) -> Column:
    return stepped(c, [(0, "emerg"), (1, "alert"), (2, "crit"), (3, "err"), (4, "warning"), (5, "notice"), (6, "info")], "debug", strict=False)


def severity_of_priority(c: Column) -> Column:
    return stepped(c, [(2, "critical"), (3, "high"), (4, "medium"), (6, "low")], "info", strict=False)


def severity_rank(c: Column) -> Column:
    return chosen(c, [("critical", 0), ("high", 1), ("medium", 2), ("low", 3), ("info", 4)], 9)


def priority_of(c: Column) -> Column:
    return chosen(c, [("critical", "P0"), ("high", "P1"), ("medium", "P2")], "P3")


def complexity_of(c: Column) -> Column:
    return chosen(c, [("critical", "L"), (("high", "medium"), "M")], "S")


def rung_rank(c: Column) -> Column:
    return chosen(c, [("record", 0), ("play", 1), ("research", 2), ("agent", 3), ("outlets", 4)], 0)


def source_class(c: Column) -> Column:
    return chosen(c, [(("sentinel", "collector"), "app"), (("journald", "dbus"), "unit")], "resource")


def merge_class(source: Column, state: Column) -> Column:
    disk = chosen(state, [(("free_pct", "inode_pct"), "disk_full"), ("io_error", "io_stall"), ("readonly", "config_error")], "disk_full")
    bus = chosen(state, [(("failed", "auto-restart"), "crash_loop")], "unit_degraded")
    rest = chosen(source, [("psi", "resource_exhaustion"), ("timers", "timer_missed"), ("inotify", "file_flap"), (("collector", "sentinel", "journald"), "crash_loop")], "unknown")
    return F.when(source == "disk", disk).when(source == "dbus", bus).otherwise(rest)


def is_failure(path: Column, substate: Column, result: Column) -> Column:
    of = lambda c, *v: F.coalesce(c.isin(*v), F.lit(False))
    return F.when(path == "properties_changed", of(substate, "failed", "auto-restart")).when(path == "job_removed", of(result, "failed", "timeout", "dependency", "canceled")).otherwise((path == "reconcile") & of(substate, "failed"))


def is_open(state: Column) -> Column:
    """Open for the ledger: escalated still is, suppressed and quarantined aren't."""
    return ~F.coalesce(state, F.lit("")).isin("resolved", "suppressed", "quarantined", "")


def is_open_ladder(state: Column) -> Column:
    """Open for the ladder: only resolved and escalated are closed."""
    return ~F.coalesce(state, F.lit("")).isin("resolved", "escalated")


def is_foldable(wake: Column, fire: Column, sample_backed: Column, repeat: Column) -> Column:
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return no(wake) & no(fire) & (~no(sample_backed) | ~no(repeat))


def event_id_ok(c: Column | str) -> Column:
    return _text(c).rlike(r"^[0-9a-f]{32}\z")


def quad(c: Column | str) -> Column:
    """array<int> of a dotted quad with octets up to 255, else null."""
    octets = F.transform(F.split(_text(c), r"\.", -1), lambda o: o.try_cast("int"))
    good = _text(c).rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}\z") & F.forall(octets, lambda o: o <= 255)
    return F.when(good, octets)


def exempt_address(c: Column | str) -> Column:
    """Loopback, private, link-local and this-network addresses."""
    q = quad(c)
    a, b = q[0], q[1]
    return F.coalesce(a.isin(127, 10, 0) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)), F.lit(False))


def zone(c: Column | str) -> Column:
    q = quad(c)
    a, b = q[0], q[1]
    lan = (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))
    return F.when(F.coalesce(a == 127, F.lit(False)), "loopback").when(F.coalesce(lan, F.lit(False)), "lan").otherwise("public")


def in_app_go(path: Column | str) -> Column:
    c = _text(path)
    return ~(F.contains(c, F.lit("/pkg/mod/")) | F.contains(c, F.lit("/vendor/")) | F.contains(c, F.lit("/usr/local/go/src/")) | F.startswith(c, F.lit("runtime/")) | (c == ""))


def unit_of_object_path(c: Column | str) -> Column:
    tail = F.when(F.contains(_text(c), F.lit("/unit/")), F.substring_index(_text(c), "/unit/", -1)).otherwise("")
    for old, new in (("_2d", "-"), ("_2e", "."), ("_5f", "_")):
        tail = F.replace(tail, F.lit(old), F.lit(new))
    return F.substring_index(F.regexp_replace(tail, "_2f\\z", ""), "/", 1)


def escape_unit(c: Column | str) -> Column:
    """Bytes other than ASCII letters and digits as `_` and two hex digits."""
    digits = F.lower(F.hex(_text(c).cast("binary")))
    each = F.transform(F.regexp_extract_all(digits, F.lit(".."), F.lit(0)), lambda h: F.when(h.rlike("^(3[0-9]|4[1-9a-f]|5[0-9a]|6[1-9a-f]|7[0-9a])\\z"), F.decode(F.unhex(h), "UTF-8")).otherwise(F.concat(F.lit("_"), h)))
    return F.array_join(each, "")


def collapse_instance(c: Column | str) -> Column:
    return F.regexp_replace(_text(c), r"^([^@]*@)[0-9.-]+", "$1")


def number(c: Column | str) -> Column:
    """A JSON value as a number, 0 if it isn't one."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).try_cast("double"), F.lit(0.0))


def semver(c: Column | str) -> Column:
    """struct<major, minor, patch>, null if it isn't a version."""
    part = lambda i: F.regexp_extract(_text(c), r"^v?(\d{1,9})\.(\d{1,9})\.(\d{1,9})\z", i)
    return F.when(part(1) != "", F.struct(part(1).try_cast("int").alias("major"), part(2).try_cast("int").alias("minor"), part(3).try_cast("int").alias("patch")))


def _segments(c: Column) -> Column:
    return F.split(_text(c), r"[.\-]", -1)


def segment_number(c: Column) -> Column:
    return F.when(c.rlike(r"^[vV]?[0-9]{1,18}\z"), F.regexp_replace(c, "^[vV]", "").try_cast("long"))


def compare_releases(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1; null if no rule orders them: an empty release, or a number against a word or nothing."""
    x, y = _text(a), _text(b)
    pairs = F.arrays_zip(_segments(x).alias("x"), _segments(y).alias("y"))

    def order(p: Column) -> Column:
        u, v = F.coalesce(p["x"], F.lit("")), F.coalesce(p["y"], F.lit(""))
        m, n = segment_number(u), segment_number(v)
        sign = lambda lo, hi: F.when(lo < hi, -1).when(lo > hi, 1).otherwise(0)
        return F.when(u == v, 0).when(m.isNotNull() & n.isNotNull(), sign(m, n)).when(m.isNotNull() | n.isNotNull(), 9).otherwise(sign(u, v))

    first = F.coalesce(F.get(F.filter(F.transform(pairs, order), lambda s: s != 0), F.lit(0)), F.lit(0))
    return F.when(x == y, 0).when((x == "") | (y == ""), F.lit(None)).when(first == 9, F.lit(None)).otherwise(first).cast("int")


def json_time(c: Column | str) -> Column:
    """Seconds since 1970 as a number, or an RFC 3339 text."""
    t = _text(c)
    return F.coalesce(F.timestamp_seconds(t.try_cast("decimal(20,6)")), t.try_cast("timestamp"))


def go_duration(text: str) -> float:
    """Seconds of a duration such as 1h30m or 250ms; 0 if it isn't one."""
    import re

    unit = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
    sign, body = (-1, text[1:]) if text.startswith("-") else (1, text.removeprefix("+"))
    parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)", body)
    return sign * sum(float(n) * unit[u] for n, u in parts) if "".join(n + u for n, u in parts) == body else 0.0


def duration_seconds(c: Column | str) -> Column:
    """The same of a column, without a sign: 0 where a text isn't a duration."""
    text = _text(c)
    part = r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)"
    numbers, units = (F.regexp_extract_all(text, F.lit(part), F.lit(g)) for g in (1, 2))
    scale = chosen_number({"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0})
    total = F.aggregate(F.zip_with(numbers, units, lambda n, u: n.try_cast("double") * scale(u)), F.lit(0.0), lambda a, x: a + x)
    return F.when(text.rlike(rf"^(?:{part})+\z"), total).otherwise(F.lit(0.0))


def chosen_number(table: dict[str, float]):
    """A function of a column: the number of a name."""
    return lambda c: chosen(c, list(table.items()), 0.0)


def fnv1a(c: Column | str) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes."""
    octets = F.transform(F.regexp_extract_all(F.hex(_text(c).cast("binary")), F.lit(".."), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("long"))
    return F.aggregate(octets, F.lit(2166136261).cast("long"), lambda acc, b: ((acc.bitwiseXOR(b)) * 16777619) % 4294967296)


def jittered(interval_ns: Column, percent: float, c: Column | str) -> Column:
    """The interval moved by up to `percent` of itself, in steps fixed by the id."""
    step = fnv1a(c) % 41 - 20
    delta = (interval_ns.cast("decimal(38,0)") * step * int(percent * 100)) / F.lit(20 * 100 * 100)
    return F.when((interval_ns <= 0) | F.lit(percent <= 0), interval_ns).otherwise(interval_ns + F.when(delta < 0, F.ceil(delta)).otherwise(F.floor(delta)).cast("long"))
