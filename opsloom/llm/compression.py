"""Quality classifier (2): zstandard dictionaries of good and bad text.

Two dictionaries are built from labelled text. A text is compressed chunk by chunk with each
of them; the normalised difference of the sizes says which kind of text it resembles, and a
logistic calibration on that difference and the compression ratio makes it a probability.
All chunks of a text count. The dictionaries and the calibration come from a bounded sample
of the labelled rows outside the held-out fold; nothing else about a row enters its score.

Edge cases: a null, empty or white-space text scores 0.0; without labels of both kinds every other text
scores 0.5; a null doc_id is scored like any other; repeated rows are each scored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, bounded_sample, held_out, pieces

#: Characters of a chunk and bytes of a dictionary; chunks of each label (and of one text) that dictionaries are built from; rows for calibration.
CHUNK, DICTIONARY, SAMPLE_CHUNKS, CHUNKS_A_TEXT, SAMPLE_ROWS = 2048, 1 << 16, 1200, 2, 6000
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...] = (0.0,) * 8

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for raw in (self.good, self.bad):
            held = zstandard.ZstdCompressionDict(raw)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False, write_checksum=False))
        return made


def measure(texts: Iterable[bytes], compressors: list) -> np.ndarray:
    """(bytes, size with the good, size with the bad dictionary) of each text."""
    good, bad = (c.compress for c in compressors)
    out = []
    for text in texts:
        g = b = 0
        for i in range(0, len(text), CHUNK):
            chunk = text[i : i + CHUNK]
            g += len(good(chunk))
            b += len(bad(chunk))
        out.append((len(text), g, b))
    return np.array(out, float).reshape(-1, 3)


def features(sizes: np.ndarray) -> np.ndarray:
    """Piecewise linear in the normalised difference and in the logarithm of the compression ratio."""
    n, good, bad = np.maximum(sizes, 1).T
    difference, ratio = np.clip(10 * (bad - good) / (bad + good), -3, 3), np.log(good / n)
    above = lambda x: np.maximum(x, 0)
    return np.column_stack([np.ones(len(n)), difference, ratio, above(-1.0 - ratio), above(-1.4 - ratio), above(-1.8 - ratio), above(difference - 0.5), above(-0.5 - difference)])


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Logistic weights by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> Model | None:
    """Dictionaries from SAMPLE_CHUNKS chunks a label, calibration on SAMPLE_ROWS other rows; those whose ids have the smallest hashes.

    The sampled ids are at most 2 * SAMPLE_CHUNKS + SAMPLE_ROWS numbers, so they are broadcast and no text is shuffled."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("_k")).agg(F.min(F.col(label).cast("int")).alias("_y"))
    for_dictionary = F.pmod(F.xxhash64("_k", F.lit(3)), F.lit(2)) == 0
    chosen = [bounded_sample(known.where(for_dictionary & (F.col("_y") == y)), "_k", SAMPLE_CHUNKS // CHUNKS_A_TEXT, 5) for y in (1, 0)]
    texts = docs.select(F.col(doc_id).alias("_k"), F.col(text).alias("_t")).where(F.length("_t") > 0)
    places = F.sequence(F.lit(0), F.floor((F.length("_t") - 1) / CHUNK).cast("int"))
    some = F.slice(F.array_sort(F.transform(places, lambda i: F.struct(F.xxhash64("_k", i).alias("h"), i.alias("i")))), 1, CHUNKS_A_TEXT)
    cut = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "_k").select("_k", "_y", F.transform(some, lambda s: F.substring(F.col("_t"), s["i"] * CHUNK + 1, F.lit(CHUNK))).alias("_c"))
    cut = cut.groupBy("_k", "_y").agg(F.min("_c").alias("_c"))  # an id that many rows have counts once, like any other
    raw: tuple[list[bytes], list[bytes]] = ([], [])
    for _, y, chunks in sorted(map(tuple, cut.collect())):
        raw[1 - y].extend(c.encode() for c in chunks)
    if not all(raw):
        return None
    model = Model(*(_dictionary(samples[:SAMPLE_CHUNKS]) for samples in raw))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in pieces(batches, "_t"):
            sizes = measure((t.encode() for t in batch.column("_t").to_pylist()), compressors)
            yield pa.RecordBatch.from_arrays([batch.column("_k"), batch.column("_y"), *(pa.array(c) for c in sizes.T)], names=["_k", "_y", "n", "g", "b"])

    kind = texts.schema["_k"].dataType.simpleString()
    few = bounded_sample(known.where(~for_dictionary), "_k", SAMPLE_ROWS, 5)
    sized = texts.join(F.broadcast(few), "_k").select("_k", "_y", "_t").mapInArrow(run, f"_k {kind}, _y int, n double, g double, b double")
    sized = sized.groupBy("_k", "_y").agg(F.min(F.struct("n", "g", "b")).alias("s")).select("_k", "_y", "s.*").toPandas().sort_values("_k")
    if sized["_y"].nunique() < 2:
        return model
    model.weights = tuple(calibrate(features(sized[["n", "g", "b"]].to_numpy()), sized["_y"].to_numpy(float)))
    return model


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the text itself where there is too little of it to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, k=256, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    bound_batches(docs.sparkSession)
    model = train(docs, labels, doc_id=doc_id, text=text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors() if model else None
        for batch in pieces(batches, "t"):
            texts = [(t or "").encode() for t in batch.column("t").to_pylist()]
            if model:
                x = features(measure(texts, compressors))
                p = 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30)))
            else:
                p = np.full(len(texts), 0.5)
            p = np.where([not t.strip() for t in texts], 0.0, p)
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(p)], names=["d", "score"])

    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    out = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(run, f"d {kind}, score double").withColumnRenamed("d", doc_id)
    return out.select(doc_id, held_out(doc_id).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
