"""WARC (3): archives with one gzip member a record, and a splittable reader.

A reading task gets a byte range, looks for the gzip magic, and takes a hit for a record only
if what it decodes to begins with a WARC version line; it owns the records that start inside
its range and reads past the end to finish the last one. So an archive of any size is read by
many tasks and without an index.

Edge cases: a null html is an empty payload; a null page_id is written without an id, is never
what others refer to, and revisits the smallest id of its payload if there is one; rows with
the smallest id of a payload are responses, all of them if it is repeated; control characters
in a url are written percent-encoded; empty archives and empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, scratch_path

MAGIC = b"\x1f\x8b\x08"
SPLIT = 8 << 20
_WRITTEN = "path string, bytes long, records long"
RECORDS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary, path string, offset long"


def revisits(pages: DataFrame, least: int = 100, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """pages with payload, digest and `refers_to`: the smallest page_id of equal payloads of at least `least` bytes, null for responses.

    Only (digest, id) pairs are aggregated; the pages meet the digests that occur twice, which hold one row each, so a payload
    of a third of all pages stays spread out (the join's skewed partitions can be split)."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"), F.sha2(body, 256).alias("payload_digest"))
    long_ones = pages.select(F.col(page_id).cast("long").alias("page_id"), F.sha2(body, 256).alias("_digest"), F.octet_length(body).alias("_n")).where(F.col("_n") >= least)
    first = long_ones.groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_copies")).where("_copies > 1 and _first is not null").drop("_copies")
    out = base.join(first.hint("shuffle_hash"), base["payload_digest"] == first["_digest"], "left")
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("_first"))
    return out.select("page_id", "url", "payload", "payload_digest", F.when(F.col("_first").isNotNull() & later, F.col("_first")).alias("refers_to"))


def _clean(text: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one uncompressed record; a response's payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
    digest, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
    if kind == "response" and (len(payload) != declared or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    urn = lambda x: int(m[1]) if x and (m := re.fullmatch(r"<urn:page:(-?\d+)>", x)) else None
    return {
        "page_id": urn(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind, "payload_digest": digest,
        "payload_bytes": declared, "refers_to": urn(fields.get("warc-refers-to")), "payload": payload if kind == "response" else None,
    }


def write(records: DataFrame, folder: str, level: int = 4) -> list[tuple[str, int, int]]:
    """Write an archive a partition into the folder (a URI); (path, bytes, records) of the archives that count.

    A name holds the attempt, and only names returned by tasks that ended are used, so a lost executor's halves are never read."""
    uri = qualified(records.sparkSession, folder)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(uri)
        task, path, out, size, count = TaskContext.get(), None, None, 0, 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "refers_to")), strict=True):
                if out is None:
                    store.create_dir(top, recursive=True)
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
                    path, out = f"{uri}/{name}", store.open_output_stream(f"{top}/{name}", compression=None)
                gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = gz.compress(record(*row)) + gz.flush()
                out.write(raw)
                size, count = size + len(raw), count + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [count]})

    return [tuple(r) for r in records.mapInArrow(run, _WRITTEN).collect()]


#: What pyarrow calls the stores that Spark's file systems name otherwise.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfs": "abfs", "abfss": "abfss", "wasbs": "abfss", "gs": "gs", "hdfs": "hdfs", "file": "file"}


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI that pyarrow opens: a path without a scheme belongs to the session's default file system."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
    scheme, _, rest = uri.partition(":")
    if scheme not in _SCHEMES:
        raise ValueError(f"archives can't be written to a store of the scheme {scheme!r}")
    return "file://" + rest.removeprefix("//") if scheme == "file" else f"{_SCHEMES[scheme]}:{rest}"


class _Bytes:
    """Bytes of a file from an offset on, read as they are needed; what is done with can be let go."""

    def __init__(self, file, size: int, at: int, ahead: int):
        self.file, self.size, self.base, self.buffer = file, size, at, bytearray()
        self.more(ahead)

    def forget(self, before: int) -> None:
        """Let go of what stands before an offset of the file."""
        del self.buffer[: before - self.base]
        self.base = before

    def more(self, n: int = 1 << 20) -> bool:
        at = self.base + len(self.buffer)
        n = min(n, self.size - at)
        if n <= 0:
            return False
        self.file.seek(at)
        self.buffer += self.file.read(n)
        return True


def members(file, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of the WARC records whose gzip member starts in [start, end)."""
    source = _Bytes(file, size, start, min(end, size) - start + len(MAGIC))
    at = start
    while at < end:
        source.forget(at)
        hit = source.buffer.find(MAGIC)
        if hit < 0 or source.base + hit >= end:
            return
        offset = source.base + hit
        decoder, got, fed = zlib.decompressobj(31), [], hit
        try:
            first = decoder.decompress(source.buffer[hit : hit + 512], 64)
            while len(first) < 7 and not decoder.eof and (hit + 512 < len(source.buffer) or source.more()):
                decoder = zlib.decompressobj(31)
                first = decoder.decompress(source.buffer[hit : hit + 65536], 64)
                if hit + 65536 <= len(source.buffer):
                    break
            if not first.startswith(b"WARC/1."):
                raise zlib.error("not a WARC record")
            decoder = zlib.decompressobj(31)
            while not decoder.eof:
                if fed >= len(source.buffer) and not source.more():
                    raise zlib.error("the archive ends inside a record")
                chunk = source.buffer[fed : fed + (1 << 16)]
                got.append(decoder.decompress(chunk))
                fed += len(chunk)
        except zlib.error:
            if got:
                raise
            at = offset + 1
            continue
        yield offset, b"".join(got)
        at = source.base + fed - len(decoder.unused_data)


def read(spark: SparkSession, archives: list[tuple[str, int]], split: int = SPLIT) -> DataFrame:
    """Records of archives given as (path, bytes), read by byte ranges."""
    bound_batches(spark)
    files = spark.createDataFrame([(p, n) for p, n, *_ in archives], "path string, bytes long")
    ranges = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split))).alias("start"))
    n = sum(-(-b // split) for _, b, *_ in archives)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, where = fs.FileSystem.from_uri(path)
                with store.open_input_file(where) as file:
                    for offset, raw in members(file, size, start, start + split):
                        rows.append(parse(raw) | {"path": path, "offset": offset})
                        held += len(raw)
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_schema())
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_schema())

    return ranges.repartition(max(1, min(n, 4096))).mapInArrow(run, RECORDS)


def _schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in RECORDS.split(", "))])


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages as archives and read them back."""
    spark = pages.sparkSession
    bound_batches(spark)
    return read(spark, [(p, n) for p, n, _ in write(revisits(pages), folder or scratch_path(spark, "warc"))])
