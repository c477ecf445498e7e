"""Substring dedup (5): sliding spans of sentences.

Every sentence starts a span: the shortest run of at least two sentences with at least
`least_words` words, and also the sentence alone if it has `long_words`. With `both_ends` every
sentence also ends a span, the shortest such run up to it, and a document without any span is
one: so every repeated run of two or more sentences and `least_words` words is covered by
repeated spans inside it, and copies of short documents go whole. Spans are named by
two 62-bit hashes of their words, so spacing doesn't matter. Of equal spans the one in the
document with the smallest id stays (the first one within that document); sentences that any
other one covers are removed.

Spans are shuffled as three numbers and pre-aggregated to (hash, smallest document, count);
a span that a third of all documents hold is one row of that table and meets its holders in a
join whose skewed partitions can be split. The text is read once more at the end.

Edge cases: a null text stays null and an empty one empty, without sentences; rows with the
same doc_id count as one document, so none of them loses to the other; rows with a null
doc_id come last; repeated spans within a document are removed but for the first; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Ranges, Runs, Words, bound_batches, flat, pieces

LEAST_WORDS, LONG_WORDS = 25, 50
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


def doc_key(doc_id: str, text: str) -> list[Column]:
    """Two numbers that name a row's document: equal rows share them, and need the same result."""
    return [F.xxhash64(F.col(doc_id)).alias("k1"), F.xxhash64(F.col(text)).alias("k2")]


class Sentences:
    """Sentences of a flat batch as ranges of words; they end at a line feed, or at white space after . ! or ?."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.words = words = Words(data, starts, ends)
        n = len(words.start)
        last = _STOP[data[words.end - 1]] if n else np.zeros(0, bool)
        feeds = np.flatnonzero(data == 10)
        broken = np.searchsorted(feeds, words.end)
        following = np.append(words.start[1:], len(data))
        last |= np.searchsorted(feeds, following) > broken
        if n:
            last |= np.append(words.doc[1:] != words.doc[:-1], True)
        self.end = np.flatnonzero(last) + 1  # in words
        self.start = np.append(0, self.end[:-1])[: len(self.end)]
        self.doc = words.doc[self.start]
        self.first = np.searchsorted(self.doc, np.arange(len(starts)))
        self.per_doc = np.searchsorted(self.doc, np.arange(len(starts)), "right") - self.first
        self._runs = Runs(Ranges(data)(words.start, words.end), 2)

    def spans(self, least_words: int, long_words: int, both_ends: bool = False) -> tuple[np.ndarray, ...]:
        """(first sentence, sentences, hash, hash) of every span, each once."""
        k, total = np.arange(len(self.end)), len(self.end)
        if not total:
            return k, k, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        stop = np.maximum(np.searchsorted(self.end, self.start + least_words), k + 1)
        inside = (stop < total) & (self.doc[np.minimum(stop, total - 1)] == self.doc)
        alone = self.end - self.start >= long_words
        first = np.concatenate([k[inside], k[alone]])
        count = np.concatenate([stop[inside] - k[inside] + 1, np.ones(int(alone.sum()), np.int64)])
        if both_ends:
            begin = np.minimum(np.searchsorted(self.start, self.end - least_words, "right") - 1, k - 1)
            ends = (begin >= 0) & (self.doc[np.maximum(begin, 0)] == self.doc)
            # a run that starts at its first and ends at its last sentence is one span, not two
            ends &= ~(inside[begin] & (stop[begin] == k))
            some = np.bincount(self.doc[first], minlength=len(self.per_doc)) > 0
            whole = np.flatnonzero((self.per_doc > 0) & ~some)
            first = np.concatenate([first, begin[ends], self.first[whole]])
            count = np.concatenate([count, k[ends] - begin[ends] + 1, self.per_doc[whole]])
        a, b = self.start[first], self.end[first + count - 1]
        h1, h2 = self._runs(a, b)
        return first, count, h1, h2


def _own_repeats(doc: np.ndarray, h1: np.ndarray, h2: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which spans repeat an earlier span of their own document."""
    order = np.lexsort((first, h2, h1, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
    out = np.zeros(len(doc), bool)
    out[order[1:][same]] = True
    return out


def spans(docs: DataFrame, least_words: int = LEAST_WORDS, long_words: int = LONG_WORDS, doc_id: str = "doc_id", text: str = "text", both_ends: bool = False) -> DataFrame:
    """h1, h2, doc, k1, k2, first, count: the first of each different span of every document."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            s = Sentences(*flat(batch.column("t")))
            first, count, h1, h2 = s.spans(least_words, long_words, both_ends)
            doc = s.doc[first]
            keep = ~_own_repeats(doc, h1, h2, first)
            first, count, h1, h2, doc = first[keep], count[keep], h1[keep], h2[keep], doc[keep]
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), *(batch.column(c).take(at) for c in ("d", "k1", "k2")), pa.array((first - s.first[doc]).astype(np.int32)), pa.array(count.astype(np.int32))],
                names=["h1", "h2", "d", "k1", "k2", "first", "count"],
            )

    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"), *doc_key(doc_id, text))
    return source.mapInArrow(run, f"h1 long, h2 long, d {kind}, k1 long, k2 long, first int, count int")


def deduplicated(docs: DataFrame, least_words: int = LEAST_WORDS, long_words: int = LONG_WORDS, doc_id: str = "doc_id", text: str = "text", both_ends: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_sentences, n_removed and the text without the removed sentences."""
    found = spans(docs, least_words, long_words, doc_id, text, both_ends)
    again = found.groupBy("h1", "h2").agg(F.min("d").alias("least"), F.count("*").alias("n")).where("n > 1 and least is not null").drop("n")
    later = F.col("d").isNull() | (F.col("d") > F.col("least"))
    packed = (F.col("first").cast("long") * (1 << 24) + F.col("count")).alias("p")
    gone = found.join(again, ["h1", "h2"]).where(later).select("k1", "k2", packed).groupBy("k1", "k2").agg(F.collect_set("p").alias("gone"))
    keyed = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"), *doc_key(doc_id, text)).join(gone, ["k1", "k2"], "left").select("d", "t", "gone")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            data, starts, ends = flat(batch.column("t"))
            s = Sentences(data, starts, ends)
            first, count, h1, h2 = s.spans(least_words, long_words, both_ends)
            own = _own_repeats(s.doc[first], h1, h2, first)
            marks = np.zeros(len(s.end) + 1, np.int64)
            np.add.at(marks, first[own], 1)
            np.add.at(marks, first[own] + count[own], -1)
            for i, listed in enumerate(batch.column("gone").to_pylist()):
                if listed:
                    p = np.array(listed, np.int64)
                    at, n = s.first[i] + (p >> 24), p & ((1 << 24) - 1)
                    np.add.at(marks, at, 1)
                    np.add.at(marks, at + n, -1)
            removed = np.cumsum(marks)[:-1] > 0
            raw, texts = data.tobytes(), []
            lost = np.bincount(s.doc[removed], minlength=len(starts)) if len(removed) else np.zeros(len(starts), np.int64)
            for i, old in enumerate(batch.column("t")):
                if not lost[i]:
                    texts.append(old.as_py())
                    continue
                a, b = s.first[i], s.first[i] + s.per_doc[i]
                # a sentence's text reaches to the next one's first word; what stands before the first word stays
                begin = s.words.start[s.start[a:b]]
                begin = np.append(begin, ends[i])
                kept = [raw[starts[i] : begin[0]], *(raw[x:y] for x, y, gone_ in zip(begin[:-1], begin[1:], removed[a:b], strict=True) if not gone_)]
                texts.append(b"".join(kept).decode())
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(s.per_doc, pa.int64()), pa.array(lost, pa.int64()), pa.array(texts, pa.string())], names=["d", "n_sentences", "n_removed", "t"])

    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    out = keyed.mapInArrow(run, f"d {kind}, n_sentences long, n_removed long, t string")
    return out.select(F.col("d").alias(doc_id), "n_sentences", "n_removed", F.col("t").alias(text))
