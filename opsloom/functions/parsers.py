"""Stack traces of assembled log blocks: Go panics, Python tracebacks, Node rejections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How a block of each parser begins and goes on.
BLOCKS = {
    "go-panic": (r"^(panic:|fatal error:)", r"^(\s|goroutine |\[signal |created by |[\w./*()]+\(.*\)\s*$|exit status|$)"),
    "py-traceback": (r"^Traceback \(most recent call last\):", r"^(\s+|[\w.]+(Error|Exception|Warning|Interrupt|Exit)\b)"),
    "node-reject": (r"^(\(node:\d+\) )?(Unhandled|Uncaught|\w*Error:)", r"^\s+at |^\[?\w*Error"),
}
FRAME = "array<struct<filename:string,function:string,module:string,lineno:int,in_app:boolean,context_line:string>>"


def _frame(file: Column, function: Column, line: Column, in_app: Column) -> Column:
    return F.struct(file.alias("filename"), function.alias("function"), F.lit("").alias("module"), line.try_cast("int").alias("lineno"), in_app.alias("in_app"), F.lit("").alias("context_line"))


def _matches(text: Column, pattern: str, groups: int) -> list[Column]:
    return [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in range(1, groups + 1)]


def go_panic(text: Column) -> Column:
    """struct<title, frames>: a call line, then its file."""
    f, file, line = _matches(text, r"(?m)^([\w./*()\-]+)\(.*\)\n\t(\S+\.go):(\d+)", 3)
    frames = F.transform(F.arrays_zip(f.alias("f"), file.alias("p"), line.alias("n")), lambda x: _frame(x["p"], F.regexp_extract(x["f"], r"([^/]+)\z", 1), x["n"], ~x["p"].rlike("/pkg/mod/|/vendor/|/usr/local/go/src/")))
    return F.struct(F.regexp_extract(text, r"^(?:panic|fatal error): (.*)", 1).alias("title"), frames.alias("frames"))


def py_traceback(text: Column) -> Column:
    """struct<title, frames>: the innermost frame last, as it is printed."""
    file, line, f = _matches(text, r'(?m)^\s+File "([^"]+)", line (\d+), in (\S+)', 3)
    frames = F.transform(F.arrays_zip(f.alias("f"), file.alias("p"), line.alias("n")), lambda x: _frame(x["p"], x["f"], x["n"], ~x["p"].rlike("site-packages/|dist-packages/|/lib/python|^<frozen")))
    return F.struct(F.regexp_extract(text, r"(?m)^((?:[\w.]+)(?:Error|Exception|Warning|Interrupt|Exit)\b.*)", 1).alias("title"), frames.alias("frames"))


def node_reject(text: Column) -> Column:
    f, file, line = _matches(text, r"(?m)^\s+at (?:async )?(?:(\S+) \()?((?:file://)?/[^:)]+|node:[^:)]+):(\d+):\d+\)?", 3)
    frames = F.transform(F.arrays_zip(f.alias("f"), file.alias("p"), line.alias("n")), lambda x: _frame(x["p"], x["f"], x["n"], ~x["p"].rlike("node_modules/|^node:")))
    return F.struct(F.regexp_extract(text, r"(?m)^(?:.*?)(\w*Error: .*)", 1).alias("title"), frames.alias("frames"))


PARSERS = {"go-panic": go_panic, "py-traceback": py_traceback, "node-reject": node_reject}
