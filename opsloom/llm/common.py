"""Shared pieces of the training-data operators: scratch tables, Arrow batches as flat byte arrays, hashes.

Text operators look at an Arrow batch as ONE byte array plus document offsets, so that
every step is a numpy pass over a few megabytes instead of a Python loop over words.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Rows and bytes of one Arrow batch: with these a worker needs about 150 MB.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
#: Rows of one batch of Spark's Parquet reader, which keeps all their texts in an array that doubles as it grows.
SCAN_ROWS = 256

_U64 = np.uint64


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound what a Python worker gets at once, and see to it that it finds this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def bound_scans(spark: SparkSession, rows: int = SCAN_ROWS) -> None:
    """Bound how many whole texts a Parquet scan of this session holds at once; Spark's own 4,096 may be half a gigabyte a task."""
    setting = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.set(setting, str(min(rows, int(spark.conf.get(setting)))))


# ---------------------------------------------------------------- scratch tables
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one of our own (local mode)."""
    here = spark.conf.get("spark.checkpoint.dir", None)
    if not here:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        here = "/tmp/checkpoints/opsloom"
    return here.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/opsloom-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the frame into the shared folder and read it again."""
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a frame made by written(); call it only when nothing reads them any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished queries: they stay until the driver's JVM finds that nothing refers to them, and it
    may not look for hours. Worth a call after each step that moved texts."""
    spark.sparkContext._jvm.System.gc()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where the frame has such a column (upper and lower case are the same to Spark)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


# ---------------------------------------------------------------- Arrow batches
def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n, (_, offsets, values) = len(column), column.buffers()
    kind = np.int64 if wide else np.int32
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8)[at[0] : at[-1]] if values is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    return data, at[:-1], at[1:]


def pieces(batches: Iterable[pa.RecordBatch], text: str, size: int = BATCH_BYTES, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Split batches so that each holds at most `rows` rows and about `size` bytes of the text column (one longer text stays whole)."""
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
        if not len(lengths):
            continue
        begin, total = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if total and total + n > size or i - begin == rows:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        yield batch.slice(begin)


# ---------------------------------------------------------------- hashes
def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = np.asarray(x, _U64).copy()
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U64) * _U64(0x9E3779B97F4A7C15))
_K = 0x9E3779B97F4A7C15 | 1
_KINV = pow(_K, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        out = np.full(max(n + 1, 1 << 16), base, _U64)
        out[0] = 1
        have = _powers[base] = np.multiply.accumulate(out)
    return have


class Rolling:
    """Hashes of byte ranges of one length from one prefix sum, a polynomial modulo 2**64: cheap enough for every place of a text,
    but different ranges of some patterns share a value, so only use it where what shares a value is compared afterwards."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix = np.zeros(n + 1, _U64)
        np.take(_BYTE, data, out=self.prefix[1:], mode="clip")  # in place: no mode but this one writes without a buffer
        self.prefix[1:] *= powers(_K, n)[:n]
        np.cumsum(self.prefix[1:], out=self.prefix[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.prefix[end] - self.prefix[start]) * powers(_KINV, len(self.prefix))[start]
        return mix(h + (end - start).astype(_U64) * _U64(0xD6E8FEB86659FD93))

    def each(self, width: int) -> np.ndarray:
        """Of every range of this width, in order."""
        n = len(self.prefix) - width
        h = (self.prefix[width:] - self.prefix[:n]) * powers(_KINV, len(self.prefix))[:n]
        return mix(h + _U64(width * 0xD6E8FEB86659FD93 % 2**64))


#: Bytes of a range from which xxh3 hashes it by itself instead of all ranges eight bytes at a time.
_LONG = 256
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], _U64)


class Ranges:
    """64-bit hashes of any byte ranges of one array: every eight bytes go through the finaliser together with what came before."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])
        self.eight = np.ndarray(len(data) + 1, "<u8", self.data, 0, (1,))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = end - start
        h = mix(n.astype(_U64) * _U64(0xD6E8FEB86659FD93))
        live, at = np.flatnonzero((n > 0) & (n <= _LONG)), 0
        while len(live):
            left = n[live] - at
            h[live] = mix(h[live] ^ (self.eight[start[live] + at] & _HEAD[np.minimum(left, 8)]))
            live, at = live[left > 8], at + 8
        if len(rest := np.flatnonzero(n > _LONG)):
            raw = memoryview(self.data)
            h[rest] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start[rest].tolist(), end[rest].tolist(), strict=True)]
        return h


_PRIME = _U64((1 << 31) - 1)
_31 = _U64(31)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1."""
    x = (x & _PRIME) + (x >> _31)
    x = (x & _PRIME) + (x >> _31)
    return np.where(x >= _PRIME, x - _PRIME, x)


def _prime_powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**31 - 1, kept between calls."""
    have = _powers.get(-base)
    if have is None or len(have) <= n:
        have = np.ones(1, _U64)
        while len(have) <= max(n, 1 << 14):
            have = np.concatenate([have, _reduced(have * _U64(pow(base, len(have), int(_PRIME))))])
        _powers[-base] = have
    return have


#: Bases of the polynomials: any large numbers below the prime.
_BASES = (1_415_926_535, 1_897_932_384, 626_433_832, 795_028_841)


class Runs:
    """Hashes of any runs of a sequence of hashes, from prefix sums of polynomials modulo the prime 2**31 - 1.

    `width` values a run, each of two polynomials over independent digests of the items: two different runs of n items share
    one with a probability of about (n / 2**31)**2, whatever their pattern."""

    def __init__(self, items: np.ndarray, width: int = 1):
        n, self.sums = len(items), []
        for k, base in enumerate(_BASES[: 2 * width]):
            total = np.zeros(n + 1, _U64)
            digest = mix(items ^ _U64((k + 1) * 0x9E3779B97F4A7C15 & 2**64 - 1)) >> _U64(33)
            np.cumsum(_reduced(digest * _prime_powers(base, n)[:n]), out=total[1:])
            self.sums.append((total, pow(base, -1, int(_PRIME))))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        values = [_reduced(_reduced(s[end] - s[start]) * _prime_powers(inverse, len(s))[start]) for s, inverse in self.sums]
        size = (end - start).astype(_U64) * _U64(0x9E3779B97F4A7C15)
        return [mix(((a << _31) | b) ^ size) for a, b in zip(values[::2], values[1::2], strict=True)]


_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False


class Words:
    """White-space words ([^\\x20\\x09-\\x0D]+) of a flat batch: byte ranges and document numbers."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, is_word: np.ndarray = _WORD):
        self.inside = inside = is_word[data]
        full = starts < ends
        head, tail = inside.copy(), inside.copy()
        head[1:] &= ~inside[:-1]
        tail[:-1] &= ~inside[1:]
        if len(data):
            head[starts[full]] = inside[starts[full]]
            tail[ends[full] - 1] = inside[ends[full] - 1]
        self.start, self.end = np.flatnonzero(head), np.flatnonzero(tail) + 1
        first = np.searchsorted(self.start, starts)
        self.per_doc = np.searchsorted(self.start, ends) - first
        self.first = first
        self.doc = np.repeat(np.arange(len(starts)), self.per_doc)


def counted(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How often the mask is true in each range."""
    at = np.flatnonzero(mask)
    return np.searchsorted(at, ends) - np.searchsorted(at, starts)


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted different values (numpy's unique hashes, which is slower on large arrays)."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


# ---------------------------------------------------------------- columns
def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bounded_sample(rows: DataFrame, key: str, n: int, seed: int, *ties: str) -> DataFrame:
    """The n rows with the smallest hashes of a key. Rows beyond a threshold that leaves a little more than n go first,
    so what tasks send to be merged doesn't grow with the number of tasks."""
    place, total = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)), rows.count()
    if total > n:
        rows = rows.where(place < int((1 << 30) * min(1.0, (n + 5 * n**0.5 + 10) / total)))
    return rows.orderBy(place, key, *ties).limit(n)
