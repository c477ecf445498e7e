"""Quality rules (9): boosted trees over document statistics.

One pass over the text gives a narrow table of statistics; the trees are fitted on the
driver from a bounded sample of its labelled rows and laid out as flat node arrays, so that
scoring a batch is a few gathers per tree. Chosen features are held monotone: more repeated
words, duplicate lines or symbols never raise a score.

Edge cases: a null or empty text has no words, fails the base rule and is dropped; a null
doc_id is scored like any other row; repeated rows are each scored; an empty table gives an
empty result; without labels of both classes every text gets the score 1.0 and the base
rules alone decide.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Ranges, Words, bound_batches, bounded_sample, counted, distinct, held_out, mix, pieces, flat, written

#: Name and direction of each feature: -1 may never raise the score, 0 is free.
FEATURES = [
    ("log_words", 0), ("mean_word_chars", 0), ("symbol_rate", -1), ("dup_line_rate", -1), ("repeat_word_rate", -1),
    ("upper_rate", 0), ("digit_rate", 0), ("mark_rate", 0), ("bar_rate", -1), ("line_words", 0), ("distinct_word_rate", 0), ("stop_rate", 0),
]
SAMPLE_ROWS = 20_000
KEEP_ABOVE = 0.3

_SYMBOL, _UPPER, _DIGIT, _MARK, _BAR, _STOP = (np.zeros(256, bool) for _ in range(6))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[list(range(65, 91))] = True
_DIGIT[list(range(48, 58))] = True
_MARK[list(b"!?")] = True
_BAR[list(b"|")] = True
_STOP[list(b".")] = True
_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def text_statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """Statistics of every text of a column; counts are exact up to 54-bit hashes within one text."""
    data, starts, ends = flat(column)
    words, hashed, n = Words(data, starts, ends), Ranges(data), len(starts)
    keep = 64 - max(1, int(n - 1).bit_length())
    doc_key = lambda doc, h: (doc.astype(np.uint64) << np.uint64(keep)) | (h >> np.uint64(64 - keep))
    different = lambda keys: np.bincount((distinct(keys) >> np.uint64(keep)).astype(np.int64), minlength=n)

    # lines: between document edges and line feeds, those with a word
    feeds = np.flatnonzero(data == 10)
    feed_doc = np.searchsorted(starts, feeds, "right") - 1
    line_start, line_end = np.concatenate([starts, feeds + 1]), np.concatenate([ends, feeds])
    line_doc = np.concatenate([np.arange(n), feed_doc])
    order = np.lexsort((line_start, line_doc))
    line_start, line_doc = line_start[order], line_doc[order]
    line_end = np.append(line_start[1:] - 1, 0)
    last = np.append(line_doc[1:] != line_doc[:-1], True)[: len(line_doc)]
    line_end = np.where(last, ends[line_doc], line_end[: len(line_doc)])
    worded = counted(words.inside, line_start, line_end) > 0
    lines = np.bincount(line_doc[worded], minlength=n)
    dup_lines = lines - different(doc_key(line_doc[worded], hashed(line_start[worded], line_end[worded])))

    # three-word windows found twice or more
    word = hashed(words.start, words.end)
    repeats = np.zeros(len(word), bool)
    if len(word) >= 3:
        whole = words.doc[2:] == words.doc[:-2]
        keys = doc_key(words.doc[:-2], mix(word[:-2] + mix(word[1:-1] + mix(word[2:]))))[whole]
        ordered = np.sort(keys)
        twice = distinct(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
            hit = np.zeros(len(word), bool)
            hit[np.flatnonzero(whole)[twice[at] == keys]] = True
            repeats = hit.copy()
            repeats[1:] |= hit[:-1]
            repeats[2:] |= hit[:-2]
    n_words = words.per_doc
    chars = (ends - starts) - counted(~words.inside | ((data & 0xC0) == 0x80), starts, ends)
    n_symbols, n_repeat = counted(_SYMBOL[data], starts, ends), np.bincount(words.doc[repeats], minlength=n)
    per_word, per_char = 1.0 / np.maximum(n_words, 1), 1.0 / np.maximum(chars, 1)
    rate = lambda table: counted(table[data], starts, ends) * per_char
    features = [
        np.log1p(n_words), chars * per_word, n_symbols * per_word, dup_lines / np.maximum(lines, 1), n_repeat * per_word,
        rate(_UPPER), rate(_DIGIT), rate(_MARK), rate(_BAR), n_words / np.maximum(lines, 1),
        different(doc_key(words.doc, word)) * per_word, counted(_STOP[data], starts, ends) * per_word,
    ]
    return {"n_words": n_words, "word_chars": chars, "n_symbols": n_symbols, "n_dup_lines": dup_lines, "n_repeat_words": n_repeat, "features": np.column_stack(features).astype(np.float64)}


def statistics(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, the counts and `features` (array<double>) of every whole text."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            got = text_statistics(batch.column("t"))
            x = got.pop("features")
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("d"), *map(pa.array, got.values()), lists], names=["d", *got, "features"])

    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    out = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(run, f"d {kind}, {_COUNTS}, features array<double>")
    return out.withColumnRenamed("d", doc_id)


# ---------------------------------------------------------------- boosted trees
@dataclass
class Trees:
    """Flat node arrays of all trees; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, direction: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 20, ridge: float = 1.0) -> Trees:
    """Logistic boosting on quantile bins; a split on a directed feature must keep its order, and bounds pass down the tree."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(p / (1 - p)))
    margin = np.full(len(x), base)
    nodes: list[list] = []
    roots = []

    def leaf_value(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + ridge), low, high))

    def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
        at = len(nodes)
        g, h = grad[rows].sum(), hess[rows].sum()
        value = leaf_value(g, h, low, high)
        nodes.append([0, np.inf, at, at, value * rate])
        if level == depth or len(rows) < 2 * least:
            margin[rows] += value * rate
            return at
        best = (1e-9, 0, 0, 0.0, 0.0)
        for j, cut in enumerate(cuts):
            if not len(cut):
                continue
            size = len(cut) + 1
            b = binned[rows, j]
            gl, hl = np.cumsum(np.bincount(b, grad[rows], size))[:-1], np.cumsum(np.bincount(b, hess[rows], size))[:-1]
            nl = np.cumsum(np.bincount(b, minlength=size))[:-1]
            vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(g - gl) / (h - hl + ridge), low, high)
            cost = lambda g_, h_, v: g_ * v + 0.5 * (h_ + ridge) * v * v
            gain = cost(g, h, value) - cost(gl, hl, vl) - cost(g - gl, h - hl, vr)
            ok = (nl >= least) & (len(rows) - nl >= least)
            if direction[j]:
                ok &= direction[j] * (vr - vl) >= 0
            gain = np.where(ok, gain, -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
        if best[0] <= 1e-9:
            margin[rows] += value * rate
            return at
        _, j, k, vl, vr = best
        middle = (vl + vr) / 2
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[direction[j]]
        goes = binned[rows, j] <= k
        left, right = grow(rows[goes], level + 1, *bounds[0]), grow(rows[~goes], level + 1, *bounds[1])
        nodes[at] = [j, float(cuts[j][k]), left, right, 0.0]
        return at

    for _ in range(rounds):
        prob = 1.0 / (1.0 + np.exp(-margin))
        grad, hess = prob - y, np.maximum(prob * (1 - prob), 1e-6)
        roots.append(grow(np.arange(len(x)), 0, -np.inf, np.inf))
    f, t, l, r, v = zip(*nodes, strict=True) if nodes else ((), (), (), (), ())
    return Trees(np.array(f, np.int64), np.array(t, float), np.array(l, np.int64), np.array(r, np.int64), np.array(v, float), np.array(roots, np.int64), depth, base)


def _known(labels: DataFrame, label: str, doc_id: str) -> DataFrame:
    """_k, _y: labelled ids outside the held-out fold, each once."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(doc_id))
    return known.groupBy(F.col(doc_id).alias("_k")).agg(F.min(F.col(label).cast("int")).alias("_y"))


def _fitted(rows: DataFrame) -> Trees | None:
    """Trees from a bounded table of _y and features."""
    rows = rows.select("_y", "features").toPandas()
    if rows["_y"].nunique() < 2:
        return None
    return fit(np.stack(rows["features"].to_numpy()), rows["_y"].to_numpy(float), [d for _, d in FEATURES])


def train(stats: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Trees | None:
    """Trees from at most sample_rows labelled rows outside the held-out fold, the ones with the smallest id hashes."""
    rows = stats.select(F.col(doc_id).alias("_k"), "features").join(_known(labels, label, doc_id), "_k")
    return _fitted(bounded_sample(rows, "_k", sample_rows, 9, "_y", "features"))


def train_on_texts(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Trees | None:
    """The same from texts whose statistics aren't known: the ids are sampled first and broadcast (sample_rows of them at most),
    so only their texts are measured. Labels of ids that docs doesn't have leave the sample smaller; an id of several texts counts once."""
    few = bounded_sample(_known(labels, label, doc_id), "_k", sample_rows, 9, "_y")
    texts = docs.select(F.col(doc_id).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(few), "_k").select(F.struct("_k", "_y").alias("_k"), "_t")
    rows = statistics(texts, "_t", "_k").groupBy("_k").agg(F.min("features").alias("features"))
    return _fitted(rows.orderBy("_k").select("_k._y", "features"))


def judge(docs: DataFrame, labels: DataFrame, keep_above: float = KEEP_ABOVE, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row of docs: doc_id, the counts, base_failed, score (probability of label 1) and kept."""
    stats = written(statistics(docs, text, doc_id), "statistics")
    model = train(stats, labels, doc_id=doc_id, sample_rows=sample_rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("features")
            x = np.asarray(column.flatten()).reshape(len(column), -1)
            score = model.score(x) if model is not None and len(x) else np.ones(len(x))
            rest = batch.drop_columns(["features"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(score)], names=[*rest.schema.names, "score"])

    kind = stats.schema[0].dataType.simpleString()
    scored = stats.withColumnRenamed(doc_id, "d").mapInArrow(run, f"d {kind}, {_COUNTS}, score double").withColumnRenamed("d", doc_id)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= keep_above))


def kept(docs: DataFrame, labels: DataFrame, keep_above: float = KEEP_ABOVE, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that judge() keeps, all columns. The model comes from the texts of sampled labels; the verdicts are made where the texts are, so these are never shuffled."""
    spark = docs.sparkSession
    bound_batches(spark)
    model = train_on_texts(docs, labels, doc_id=doc_id, text=text, sample_rows=sample_rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            got = text_statistics(batch.column(text))
            score = model.score(got["features"]) if model is not None else np.ones(batch.num_rows)
            failed = (got["n_words"] < 50) | (100 * got["n_repeat_words"] > 50 * got["n_words"])
            yield batch.filter(pa.array(~failed & (score >= keep_above)))

    return docs.mapInArrow(run, docs.schema)
