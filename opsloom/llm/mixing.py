"""Mixing sources to target weights (6): balanced sampling by the cube method.

Each source has a target number of words; target / size is the expected number of copies of
each of its documents. The whole part is taken outright, the fraction is an inclusion
probability. The flight phase moves the probabilities of three documents at a time along the
null space of the two balance equations of their source (documents, words) until one of them
is 0 or 1. It streams, holding three documents; blocks of documents fly independently, what
they leave (two documents a source at most) flies again together, and the last one or two
documents of a source land on the corner nearest to the target.

Edge cases: a null text has size 0; a null source is a source of its own, ranked last; an
empty table gives an empty result; a corpus without words has targets of 0; repeated rows
are separate documents. Draws are seeded by block and source, and rows are ordered by
their own values, so reruns agree whatever the partitions were.
"""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, dropped, written

#: Documents of a block in the first flight, and blocks that later flights bring together.
BLOCK, FAN_IN = 20_000, 256
WORD = r"[^\x20\x09-\x0D]+"
_EPS = 1e-9


def words_of(text: str) -> Column:
    """Number of white-space words, 0 for null."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """source, source_size, target. Weights repeat over the sources in code-point order (null last); a target
    stops at `most` times its source's size and the excess is shared again by weight until none is above.

    Ranks come from range partitions and their counts, and the shares from a few sums, so any number of sources works."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = (F.col("source").isNotNull().desc(), F.col("source").asc())
    parts = written(sums.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "sources")
    before, total = {}, 0
    for part, n in sorted(map(tuple, parts.groupBy("_part").count().collect())):
        before[part], total = total, total + n
    offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv]), F.col("_part").cast("long")) if before else F.lit(0)
    rank = offset + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    weighed = parts.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")).drop("_part")
    level, at_cap = 0.0, -1
    while True:
        over = F.coalesce(most * F.col("source_size") < level * F.col("weight"), F.lit(False))
        row = weighed.agg(
            F.sum("source_size"), F.count_if(over), F.sum(F.when(over, most * F.col("source_size")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))
        ).first()
        if row[0] is None or row[1] == at_cap:
            break
        at_cap, level = row[1], (row[0] - row[2]) / row[3] if row[3] else 0.0
    return weighed.select("source", "source_size", F.least(most * F.col("source_size"), level * F.col("weight")).alias("target"))


class Flight:
    """The flight phase of one block and source: add() returns the units that are decided."""

    def __init__(self, seed: str):
        self.random = random.Random(int.from_bytes(hashlib.sha256(seed.encode()).digest()[:8], "big"))
        self.active: list[list] = []  # [probability, size, row]

    def _step(self) -> None:
        a, b, c = self.active
        u = (c[1] - b[1], a[1] - c[1], b[1] - a[1])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        scale = max(map(abs, u))
        u = [x / scale for x in u]
        up = min((1 - x[0]) / v if v > 0 else x[0] / -v for x, v in zip(self.active, u, strict=True) if v)
        down = min(x[0] / v if v > 0 else (1 - x[0]) / -v for x, v in zip(self.active, u, strict=True) if v)
        move = up if self.random.random() * (up + down) < down else -down
        for x, v in zip(self.active, u, strict=True):
            x[0] += move * v

    def add(self, p: float, size: float, row: tuple) -> list[tuple[float, tuple]]:
        self.active.append([p, size, row])
        done: list = []
        while True:
            for x in self.active:
                if x[0] < _EPS or x[0] > 1 - _EPS:
                    done.append((float(round(x[0])), x[2]))
            self.active = [x for x in self.active if _EPS <= x[0] <= 1 - _EPS]
            if len(self.active) < 3:
                return done
            self._step()

    def rest(self, land: bool) -> list[tuple[float, tuple]]:
        """What is left, as it is or landed on the corner whose words come nearest to what was meant."""
        if not land or not self.active:
            return [(x[0], x[2]) for x in self.active]
        meant = sum(x[0] * x[1] for x in self.active)
        count = sum(x[0] for x in self.active)
        corners = [tuple(k >> i & 1 for i in range(len(self.active))) for k in range(1 << len(self.active))]
        best = min(corners, key=lambda c: (abs(sum(i * x[1] for i, x in zip(c, self.active, strict=True)) - meant), abs(sum(c) - count), c))
        return [(float(i), x[2]) for i, x in zip(best, self.active, strict=True)]


def _flown(land: bool, level: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, flight, schema = None, None, None

        def batch_of(done: list) -> pa.RecordBatch:
            rows = [[*r[:i], p, *r[i + 1 :]] for p, r in done]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            schema, done = batch.schema, []
            i = schema.get_field_index("p")
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                named = dict(zip(schema.names, row, strict=True))
                if key != (named["block"], named["source"]):
                    if flight:
                        done += flight.rest(land)
                    key = (named["block"], named["source"])
                    flight = Flight(f"{level}|{key[0]}|{key[1]!r}")
                done += flight.add(named["p"], float(named["size"]), row)
            if done:
                yield batch_of(done)
        if flight and (done := flight.rest(land)):
            yield batch_of(done)

    return run


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, copies and taken (words that the mix takes)."""
    spark = docs.sparkSession
    bound_batches(spark, 10_000)
    sized = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_of(text).alias("size")), "sized")
    rates = written(targets(sized, weights, most).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), "targets")
    joined = sized.join(rates, sized["source"].eqNullSafe(rates["source"])).drop(rates["source"])
    whole = F.floor(F.col("rate") + _EPS)
    n = sized.count()
    blocks = max(1, math.ceil(n / BLOCK))
    flying = joined.select(
        "doc_id", "source", "size", "source_size", "target", whole.alias("whole"), F.greatest(F.col("rate") - whole, F.lit(0.0)).alias("p"),
        F.pmod(F.xxhash64("doc_id", "size", F.lit(17)), F.lit(blocks)).alias("block"),
    )
    out, level = None, 0
    while True:
        land = blocks == 1
        parts = min(blocks * (1 if level == 0 else 4), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = flying.repartition(max(parts, 1), "block", "source").sortWithinPartitions("block", "source", F.xxhash64("doc_id", F.lit(level)), "doc_id", "size", "p")
        flown = written(dealt.mapInArrow(_flown(land, level), flying.schema), f"flight{level}")
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        decided = flown.where(~open_)
        out = decided if out is None else out.unionByName(decided)
        if land:
            break
        level, blocks = level + 1, math.ceil(blocks / FAN_IN)
        flying = flown.where(open_).withColumn("block", F.pmod("block", F.lit(blocks)))
    dropped(sized)
    copies = (F.col("whole") + F.col("p")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
