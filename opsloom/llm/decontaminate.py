"""Benchmark decontamination (4): an FM-index per shard of training text.

A shard is what one task holds of the documents at a time. Its words are coded by the
benchmark's vocabulary; a word outside it ends every window, so only runs of known words as
long as the shortest window enter the index. The index is a suffix array's Burrows-Wheeler
transform in a wavelet matrix, the transform's symbol counts, and every 16th suffix position.
All windows of the benchmark are searched backwards at once; occurrences are located by
walking to a sampled position and merged into removal spans.

The benchmark is the stated query set: it is split into blocks
of a bounded size. One block, the common case, is broadcast and all is done in one pass that
shuffles nothing; several are a pass each, so that neither the driver nor a worker ever holds more than one.

Edge cases: null and empty texts and items have no words and neither hit nor are hit; an item
with fewer words than the window is one window; items with the same id count once and a null
id counts as the empty string; an empty benchmark contaminates nothing; repeated rows are
judged each for itself.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, pieces, unused, written
from .sentence_spans import doc_key

WINDOW = 13
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Tokens of one index (21 bits, so that two ranks and a position fit 64) and benchmark bytes of one broadcast.
SHARD, BLOCK_BYTES = 1 << 20, 4 << 20
_SAMPLE = 16
_BITS = np.uint64(21)


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "replace").lower())


# ---------------------------------------------------------------- the index
def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes that are still tied are sorted again."""
    n = len(symbols)
    at = np.arange(n, dtype=np.uint64)
    packed = np.sort((symbols.astype(np.uint64) << _BITS) | at)
    order = (packed & np.uint64((1 << 21) - 1)).astype(np.int64)
    head = packed >> _BITS
    first = np.maximum.accumulate(np.where(np.append(True, head[1:] != head[:-1]), np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    sizes = np.bincount(first, minlength=n)
    tied = order[sizes[first] > 1]
    step = 1
    while len(tied):
        follow = np.where(tied + step < n, rank[np.minimum(tied + step, n - 1)] + 1, 0)
        packed = np.sort((rank[tied].astype(np.uint64) << np.uint64(42)) | (follow.astype(np.uint64) << _BITS) | tied.astype(np.uint64))
        order = (packed & np.uint64((1 << 21) - 1)).astype(np.int64)
        old, new, i = packed >> np.uint64(42), packed >> _BITS, np.arange(len(packed))
        old_first = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), i, 0))
        new_first = np.maximum.accumulate(np.where(np.append(True, new[1:] != new[:-1]), i, 0))
        rank[order] = old.astype(np.int64) + new_first - old_first
        sizes = np.bincount(new_first, minlength=len(packed))
        tied = order[sizes[new_first] > 1]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class WaveletMatrix:
    """Ranks of any symbol of an integer sequence: a bit vector a level, with counts every 64 bits."""

    def __init__(self, values: np.ndarray, bits: int):
        self.n, self.levels = len(values), []
        for level in range(bits - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            chunks = packed.view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(chunks).astype(np.int64))[:-1]])
            zeros = int(self.n - bit.sum())
            self.levels.append((level, chunks, before, zeros))
            values = np.concatenate([values[~bit], values[bit]])

    @staticmethod
    def _ones(chunks: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[at >> 6] + np.bitwise_count(chunks[at >> 6] & mask).astype(np.int64)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol stands before position at."""
        start = np.zeros_like(at)
        for level, chunks, before, zeros in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            a, b = self._ones(chunks, before, start), self._ones(chunks, before, at)
            start, at = np.where(one, zeros + a, start - a), np.where(one, zeros + b, at - b)
        return at - start

    def get(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for level, chunks, before, zeros in self.levels:
            one = ((chunks[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            a = self._ones(chunks, before, at)
            at = np.where(one, zeros + a, at - a)
            out |= one.astype(np.int64) << level
        return out


class FMIndex:
    """Index of a sequence of codes in which 0 separates runs; the sequence must begin and end with 0."""

    def __init__(self, codes: np.ndarray, sigma: int):
        n = len(codes)
        zero = codes == 0
        n_zero = int(zero.sum())
        symbols = codes.astype(np.int64) + n_zero - 1
        symbols[zero] = np.arange(n_zero)  # separators differ, so ties end with their run
        order = suffix_order(symbols)
        self.n, self.count = n, np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=sigma))])
        self.bwt = WaveletMatrix(codes[order - 1].astype(np.int64), max(1, int(sigma - 1).bit_length()))
        sampled = (order % _SAMPLE == 0) | zero[order - 1]  # a walk never crosses a separator
        self.sampled, self.position = sampled, np.where(sampled, order, -1)[sampled]
        self.slot = np.cumsum(sampled) - 1

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each pattern (rows of one length)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, j]
            low[live] = self.count[symbol] + self.bwt.rank(symbol, low[live])
            high[live] = self.count[symbol] + self.bwt.rank(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes given by row."""
        out, steps, left = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        at = rows.copy()
        while len(left):
            done = self.sampled[at[left]]
            out[left[done]] = self.position[self.slot[at[left[done]]]] + steps[left[done]]
            left = left[~done]
            if len(left):
                symbol = self.bwt.get(at[left])
                at[left] = self.count[symbol] + self.bwt.rank(symbol, at[left])
                steps[left] += 1
        return out


# ---------------------------------------------------------------- the benchmark
@dataclass
class Block:
    """Windows of some items: codes of their words, windows by length, items by window."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    windows: dict[int, np.ndarray] = field(default_factory=dict)  # length -> (windows, length)
    owners: dict[int, list[tuple[int, ...]]] = field(default_factory=dict)  # length -> items of each window
    items: list[str] = field(default_factory=list)

    @property
    def shortest(self) -> int:
        return min(self.windows, default=0)


def block_of(items: Iterable[tuple[object, str | None]], window: int = WINDOW) -> Block:
    out, found = Block(), {}
    ids: dict[str, int] = {}
    for item, text in items:
        coded = [out.vocabulary.setdefault(w, len(out.vocabulary) + 1) for w in words(text)]
        k = ids.setdefault("" if item is None else str(item), len(ids))
        n = min(window, len(coded))
        for i in range(len(coded) - n + 1 if n else 0):
            found.setdefault(n, {}).setdefault(tuple(coded[i : i + n]), set()).add(k)
    for n, by_window in found.items():
        out.windows[n] = np.array(list(by_window), np.int64).reshape(-1, n)
        out.owners[n] = [tuple(sorted(x)) for x in by_window.values()]
    out.items = list(ids)
    return out


def block_count(benchmark: DataFrame, text: str = "text", size: int = BLOCK_BYTES) -> int:
    """Blocks that hold about `size` bytes of the benchmark each."""
    return max(1, math.ceil((benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0) / size))


def block_at(benchmark: DataFrame, k: int, n: int, window: int = WINDOW, item_id: str = "item_id", text: str = "text"):
    """Broadcast of block k of n."""
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t"))
    part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
    return benchmark.sparkSession.sparkContext.broadcast(block_of(((r.i, r.t) for r in part.toLocalIterator()), window))


# ---------------------------------------------------------------- the search
def occurrences(texts: list[list[bytes]], block: Block) -> tuple[list[list[tuple[int, int]]], list[set[int]]]:
    """Per text: merged spans of hit words, and the items with an occurring window."""
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[int]] = [set() for _ in texts]
    if not block.windows:
        return spans, items
    get, longest = block.vocabulary.get, max(block.windows)
    runs: list[tuple[int, int, np.ndarray]] = []
    for k, text in enumerate(texts):
        codes = np.array([get(w, 0) for w in text], np.int64)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], codes > 0, [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= block.shortest:
                step = SHARD // 2
                for i in range(a, b, step):  # a run longer than an index overlaps its next piece
                    if i == a or b - i >= block.shortest:
                        runs.append((k, i, codes[i : min(b, i + step + longest - 1)]))
    begin = 0
    while begin < len(runs):
        end, total = begin, 1
        while end < len(runs) and (end == begin or total + len(runs[end][2]) + 1 <= SHARD):
            total += len(runs[end][2]) + 1
            end += 1
        _search(runs[begin:end], total, block, spans, items)
        begin = end
    return [_merged(s) for s in spans], items


def _search(runs: list, total: int, block: Block, spans: list, items: list) -> None:
    codes, owner, word = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, np.int64)
    at = 1
    for k, i, run in runs:
        codes[at : at + len(run)], owner[at : at + len(run)] = run, k
        word[at : at + len(run)] = np.arange(i, i + len(run))
        at += len(run) + 1
    index = FMIndex(codes, len(block.vocabulary) + 1)
    for n, windows in block.windows.items():
        low, high = index.search(windows)
        hit = np.flatnonzero(low < high)
        if not len(hit):
            continue
        counts = high[hit] - low[hit]
        rows = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        found, which = index.locate(rows), np.repeat(hit, counts)
        pairs = np.unique(owner[found] * len(windows) + which)
        for k, w in zip((pairs // len(windows)).tolist(), (pairs % len(windows)).tolist(), strict=True):
            items[k].update(block.owners[n][w])
        found = np.sort(found)
        cut = np.append(True, (found[1:] > found[:-1] + n) | (owner[found[1:]] != owner[found[:-1]]))
        first, last = found[cut], found[np.append(cut[1:], True)] + n
        for k, a, b in zip(owner[first].tolist(), word[first].tolist(), (word[last - 1] + 1).tolist(), strict=True):
            spans[k].append((a, b))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _found(texts: list[str | None], shared, known: tuple[list, list] | None = None) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """Words of each text, its merged spans of hit words and its items: those of one block, or known ones of all blocks."""
    split = [words(t) for t in texts]
    if known is not None:
        spans = [_merged([(x["start"], x["end"]) for x in s or ()]) for s in known[0]]
        return [len(x) for x in split], spans, [sorted(set(i or ())) for i in known[1]]
    spans, items = occurrences(split, shared.value)
    return [len(x) for x in split], spans, [sorted(shared.value.items[x] for x in i) for i in items]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _shown(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPANS)


def _over_blocks(docs: DataFrame, benchmark: DataFrame, n: int, window: int, doc_id: str, text: str, names: tuple[str, str]) -> DataFrame:
    """docs with the spans and items of all blocks of a large benchmark. Each block is a pass of its own, so a worker holds one at a
    time; only what is hit is written, and meets its documents by their keys."""
    found = None
    for k in range(n):
        shared = block_at(benchmark, k, n, window)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "t", 8 << 20):
                _, spans, items = _found(batch.column("t").to_pylist(), shared)
                out = pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), _shown(spans), pa.array(items, pa.list_(pa.string()))], names=["k1", "k2", "spans", "items"])
                yield out.filter(pa.array([bool(s) for s in spans], pa.bool_()))

        source = docs.select(F.col(text).alias("t"), *doc_key(doc_id, text))
        hits = written(source.mapInArrow(run, "k1 long, k2 long, spans array<struct<start:long,end:long>>, items array<string>"), f"hits{k}")
        shared.unpersist()
        found = hits if found is None else found.unionByName(hits)
    k1, k2 = unused(docs, "_k1", "_k2")
    every = lambda c, name: F.flatten(F.collect_list(c)).alias(name)
    by_doc = found.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(every("spans", names[0]), every("items", names[1]))
    keyed = docs.select("*", *(c.alias(name) for c, name in zip(doc_key(doc_id, text), (k1, k2), strict=True)))
    return keyed.join(by_doc, [k1, k2], "left").select(*docs.columns, *names)


def _contaminated(n_words: int, spans: list[tuple[int, int]], share: int = 20) -> bool:
    n_hit = sum(b - a for a, b in spans)
    return n_hit > 0 and share * n_hit >= n_words


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, spans of hit words [start, end), items, contaminated (a twentieth of the words hit)."""
    bound_batches(docs.sparkSession)
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    source, n = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")), block_count(benchmark, size=block_bytes)
    if n > 1:
        source, shared = _over_blocks(source, benchmark, n, window, "d", "t", ("spans", "items")), None
    else:
        shared = block_at(benchmark, 0, 1, window)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t", 8 << 20):
            known = None if shared is not None else (batch.column("spans").to_pylist(), batch.column("items").to_pylist())
            n, spans, items = _found(batch.column("t").to_pylist(), shared, known)
            hits = [sum(b - a for a, b in s) for s in spans]
            flags = [_contaminated(k, s) for k, s in zip(n, spans, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("d"), pa.array(n, pa.int64()), pa.array(hits, pa.int64()), _shown(spans), pa.array(items, pa.list_(pa.string())), pa.array(flags, pa.bool_())],
                names=["d", "n_words", "n_hit", "spans", "items", "contaminated"],
            )

    schema = f"d {kind}, n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<string>, contaminated boolean"
    return source.mapInArrow(run, schema).withColumnRenamed("d", doc_id)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns."""
    bound_batches(docs.sparkSession)
    n, source, names = block_count(benchmark, size=block_bytes), docs, unused(docs, "_spans", "_items")
    if n > 1:
        source, shared = _over_blocks(docs, benchmark, n, window, doc_id, text, tuple(names)), None
    else:
        shared = block_at(benchmark, 0, 1, window)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, 8 << 20):
            known = None if shared is not None else tuple(batch.column(c).to_pylist() for c in names)
            n, spans, _ = _found(batch.column(text).to_pylist(), shared, known)
            kept = batch.filter(pa.array([not _contaminated(k, s) for k, s in zip(n, spans, strict=True)], pa.bool_()))
            yield kept if shared is not None else kept.drop_columns(names)

    return source.mapInArrow(run, docs.schema)
