"""Suffix-array dedup (10): deep-shallow sorting of anchored suffixes.

A byte is removed if a string of `length` bytes around it also starts anywhere else. Sorting
every suffix of a corpus isn't needed for that: every such string contains an anchor, the
leftmost smallest-hashed seed of `SEED` bytes in it, which equal strings share at the same
offset. So a sparse suffix array of the anchors is enough.

1. Each document is cut into fragments: an anchor with all the strings that choose it, about
   one in 70 bytes. Seeds are pre-aggregated by batch and counted; only fragments of seeds that
   occur twice go on. A fragment that occurs twice is repeated as a whole: its text never moves.
2. Seeds with several different fragments may share some of their strings. The text of one
   copy of each such fragment goes to the task of its seed. There the suffixes that begin at
   the anchors and the reversed prefixes that end there are sorted deep-shallow: multikey
   quicksort on eight-byte characters down to SHALLOW bytes, then a blind trie for each group
   that is still tied. Common-prefix lengths of neighbours on both sides tell exactly which
   strings of a fragment occur in another one.
3. A seed with more than HOT different fragments is dealt further before it is sorted: by ranges
   of offsets and the bytes that all strings of a range share, ever narrower ones until a group
   is small enough or its fragments share a whole string.
4. Every document reads the results for its fragments and drops the covered bytes.

Edge cases: a null text is empty; texts shorter than `length` lose nothing; repeated rows are
separate documents and repeat each other; strings overlap freely, also within one document; a
string never crosses documents; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Ranges, Rolling, bound_batches, dropped, flat, mix, pieces, release, written
from .sentence_spans import doc_key

LENGTH, SEED, SHALLOW, HOT = 200, 32, 32, 4096
#: Places whose anchors are looked for at a time; places of one block fit the low bits.
BLOCK = 1 << 17
_LOW = np.uint64((1 << 22) - 1)
_FOUND = "g long, f long, k1 long, k2 long, at long, back int, ahead int"


# ---------------------------------------------------------------- fragments
def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _joined(low: np.ndarray, high: np.ndarray, anchor: np.ndarray, doc: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of string starts, where neighbours that follow each other with one anchor (whose hash is g) in one document become one."""
    cut = np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (low[1:] != high[:-1] + 1))
    return low[cut], high[np.append(np.flatnonzero(cut)[1:] - 1, len(low) - 1)], anchor[cut], doc[cut], g[cut]


def fragments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Anchors of all strings of `length` bytes: doc, at (bytes from the document's start), back and ahead
    (bytes of the fragment before and from the anchor on), g and f (hashes of seed and fragment)."""
    none = {k: np.zeros(0, np.int64) for k in ("doc", "at", "back", "ahead", "g", "f")}
    long_ones = np.flatnonzero(ends - starts >= length)
    if not len(long_ones):
        return none
    parts = []
    lows, highs = starts[long_ones], ends[long_ones] - length + 1  # string starts [low, high)
    for begin in range(0, len(data) - length + 1, BLOCK):  # a block at a time, hashes included, as each byte needs some hundred bytes on the way
        end = min(begin + BLOCK, len(data) - length + 1)
        seed_hash = Rolling(data[begin : end + length - 1]).each(SEED)
        packed = (seed_hash & ~_LOW) | np.arange(len(seed_hash), dtype=np.uint64)
        anchor = (_sliding_min(packed, length - SEED + 1) & _LOW).astype(np.int64)
        edge = np.zeros(end - begin + 1, np.int64)
        inside = (lows < end) & (highs > begin)
        np.add.at(edge, np.maximum(lows[inside], begin) - begin, 1)
        np.add.at(edge, np.minimum(highs[inside], end) - begin, -1)
        place = np.flatnonzero(np.cumsum(edge)[:-1] > 0) + begin
        if len(place):
            anchor, doc = anchor[place - begin], np.searchsorted(starts, place, "right") - 1
            parts.append(_joined(place, place, anchor + begin, doc, seed_hash[anchor]))
    low, high, anchor, doc, g = _joined(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    return {
        "doc": doc, "at": anchor - starts[doc], "back": anchor - low, "ahead": high + length - anchor,
        "g": g.view(np.int64), "f": mix(Ranges(data)(low, high + length) + (anchor - low).astype(np.uint64)).view(np.int64),
    }


def _seeds_of(docs: DataFrame, length: int, text: str) -> DataFrame:
    """g, n: the seed of every fragment and how many fragments of a batch have it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            g = np.sort(fragments(*flat(batch.column("t")), length)["g"])
            head = np.flatnonzero(np.append(True, g[1:] != g[:-1])[: len(g)])
            yield pa.RecordBatch.from_arrays([pa.array(g[head]), pa.array(np.diff(np.append(head, len(g))))], names=["g", "n"])

    return docs.select(F.col(text).alias("t")).mapInArrow(run, "g long, n long")


def _fragments_of(docs: DataFrame, length: int, doc_id: str, text: str) -> DataFrame:
    """Fragments of all documents: g, f (hashes of seed and fragment), k1, k2 (the document), at, back, ahead."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            x = fragments(*flat(batch.column("t")), length)
            doc = pa.array(x["doc"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(x["g"]), pa.array(x["f"]), batch.column("k1").take(doc), batch.column("k2").take(doc), pa.array(x["at"]), pa.array(x["back"].astype(np.int32)), pa.array(x["ahead"].astype(np.int32))],
                names=["g", "f", "k1", "k2", "at", "back", "ahead"],
            )

    return docs.select(F.col(text).alias("t"), *doc_key(doc_id, text)).mapInArrow(run, _FOUND)


# ---------------------------------------------------------------- deep-shallow sorting
def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two byte strings of one length."""
    differ = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (differ.bit_length() + 7) // 8


class BlindTrie:
    """A trie of branching places only: a search skips to them without comparing, and one comparison at the end places a string."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list = [len(strings[0]), {}, [0]]  # [depth, children by byte, strings if a leaf]
        for i in range(1, len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        text, node = self.strings[i], self.root
        while node[1]:
            child = node[1].get(text[node[0]])
            node = child if child is not None else next(iter(node[1].values()))
        common = _common(text, self.strings[node[2][0]])
        if common == len(text):
            node[2].append(i)
            return
        node = self.root
        while node[0] < common:
            node = node[1][text[node[0]]]
        if node[0] == common and node[1]:
            node[1][text[common]] = [len(text), {}, [i]]
            return
        below = list(node)
        other = self._leaf(node)
        node[:] = [common, {self.strings[other][common]: below, text[common]: [len(text), {}, [i]]}, []]

    def _leaf(self, node: list) -> int:
        while node[1]:
            node = next(iter(node[1].values()))
        return node[2][0]

    def order(self) -> tuple[list[int], list[int]]:
        """Strings in order, and the common prefix of each with the one before."""
        out, common, stack = [], [], [(self.root, 0)]
        while stack:
            node, before = stack.pop()
            if not node[1]:
                for k, i in enumerate(node[2]):
                    out.append(i)
                    common.append(before if k == 0 else node[0])
                continue
            children = [node[1][b] for b in sorted(node[1])]
            for k in range(len(children) - 1, -1, -1):
                stack.append((children[k], before if k == 0 else node[0]))
        return out, common


def deep_shallow(rows: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte matrix, and each row's common prefix with the row before it in that order.

    Multikey quicksort, eight bytes at a time and all groups at once, down to `shallow` bytes; blind tries below."""
    m, width = rows.shape
    chars = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -width % 8)))).view(">u8").astype(np.uint64)
    order, head = np.arange(m), np.zeros(m, bool)  # head: the row differs from the one before it
    head[:1] = True
    common = np.zeros(m, np.int64)
    for c in range(min(-(-shallow // 8), chars.shape[1])):
        group = np.cumsum(head)
        tied = np.flatnonzero(~head | np.append(~head[1:], False))
        if not len(tied):
            break
        rank = np.lexsort((chars[order[tied], c], group[tied]))
        order[tied] = order[tied[rank]]
        now = chars[order, c]
        differ = now[1:] ^ now[:-1]
        new = np.append(False, (differ != 0) & ~head[1:])
        at = np.flatnonzero(new)
        d = differ[at - 1]
        zero_bytes = np.zeros(len(at), np.int64)
        for k in range(1, 8):
            zero_bytes += (d >> np.uint64(64 - 8 * k)) == 0
        common[at] = np.minimum(8 * c + zero_bytes, width)
        head |= new
    starts = np.flatnonzero(head)
    sizes = np.diff(np.append(starts, m))
    for a, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        members = order[a : a + n]
        ranked, shared = BlindTrie([rows[i].tobytes() for i in members]).order()
        order[a : a + n] = members[ranked]
        common[a + 1 : a + n] = shared[1:]
    return order, common


def shared_strings(left: list[bytes], right: list[bytes], length: int = LENGTH, lowest: int = 0, highest: int | None = None, group: list | None = None) -> list[tuple[int, int, int]]:
    """(fragment, first, last): the runs of string offsets (bytes before the anchor, lowest to highest) that occur in another fragment too.

    left holds the bytes before the anchor, right those from it on; the fragments differ. Those of different groups have nothing to do
    with each other, though they are sorted together."""
    m = len(left)
    back, ahead = np.array([len(x) for x in left], np.int64), np.array([len(x) for x in right], np.int64)
    highest = length if highest is None else highest
    kinds: dict = {}
    of = np.array([kinds.setdefault(k, len(kinds)) for k in group], np.int64) if group is not None else np.zeros(m, np.int64)

    def matrix(texts: list[bytes], width: int, reverse: bool) -> np.ndarray:
        out = np.zeros((m, width), np.uint8)
        for i, x in enumerate(texts):
            row = np.frombuffer(x, np.uint8)
            out[i, : len(row)] = row[::-1] if reverse else row
        return out

    right_order, right_common = deep_shallow(matrix(right, length, False))
    left_order, left_common = deep_shallow(matrix(left, length, True))
    hit = np.zeros((m, length), bool)
    for o in range(lowest, min(int(back.max(initial=0)), highest) + 1):
        valid = np.flatnonzero((back >= o) & (ahead >= length - o))
        if len(valid) < 2:
            continue
        run_right, run_left = np.empty(m, np.int64), np.empty(m, np.int64)
        run_right[right_order] = np.cumsum(right_common < length - o)
        run_left[left_order] = np.cumsum(left_common < o)
        keys = (of[valid] * (m + 1) + run_right[valid]) * (m + 1) + run_left[valid]
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        hit[valid[order[1:][same]], o] = True
        hit[valid[order[:-1][same]], o] = True
    edges = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    who, first = np.nonzero(edges == 1)
    last = np.nonzero(edges == -1)[1] - 1
    return list(zip(who.tolist(), first.tolist(), last.tolist(), strict=True))


# ---------------------------------------------------------------- the operator
#: Offsets that strings of one group of a very common seed may have, from step to step.
WIDTHS = (57, 19, 6, 2, 1)


def _split_hot(texts: DataFrame, length: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """Groups of at most `hot` fragments from seeds with more of them, and the runs of strings that need no sorting.

    Equal strings whose anchor stands a to b bytes behind their start share a core, the a bytes before it and the length - b from
    it on. So the fragments of a seed are dealt by ranges of offsets and the core of each; what is still too large is dealt by
    narrower ranges, whose cores are longer, until a core is a string of its own and its holders are known to repeat it."""
    spark = texts.sparkSession
    none = texts.limit(0).select(F.col("g").alias("key"), F.lit(0).alias("a"), F.lit(0).alias("b"), "g", "f", "left", "right")
    done, at_once = none, none.select("g", "f", F.col("a").alias("first"), F.col("b").alias("last"))
    left = texts.select("g", "f", "left", "right", F.lit(0).alias("a"), F.lit(length - SEED).alias("b"))
    if not left.limit(1).count():
        return done, at_once
    for width in WIDTHS:
        begin = F.explode(F.sequence(F.col("a"), F.col("b"), F.lit(width)))
        each = left.withColumn("begin", begin).withColumn("end", F.least(F.col("begin") + width - 1, F.col("b")))
        fits = (F.octet_length("left") >= F.col("begin")) & (F.octet_length("right") >= length - F.col("end"))
        core = ("g", "begin", F.substring("left", F.octet_length("left") - F.col("begin") + 1, F.col("begin")), F.substring("right", F.lit(1), length - F.col("end")))
        # sorting tells apart what only shares a hash; where nothing is sorted any more, 128 bits do
        again = F.xxhash64(F.lit(2), *core) if width == 1 else F.lit(0).cast("long")
        each = written(each.where(fits).select(F.xxhash64(*core).alias("key"), again.alias("again"), F.col("begin").alias("a"), F.col("end").alias("b"), "g", "f", "left", "right"), f"cores{width}")
        sized = each.join(each.groupBy("key", "again").agg(F.count("*").alias("m")).where("m > 1"), ["key", "again"]).drop("again")
        if width == 1:
            return done, sized.select("g", "f", F.col("a").alias("first"), F.col("b").alias("last"))
        done = done.unionByName(sized.where(F.col("m") <= hot).drop("m"))
        left = written(sized.where(F.col("m") > hot).select("g", "f", "left", "right", "a", "b"), f"left{width}")
        release(spark)
        if not left.limit(1).count():
            break
    return done, at_once


def _sorted_groups(rows: DataFrame, length: int) -> DataFrame:
    """g, f, first, last: what shared_strings finds in every group (key, a, b) of fragments."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # whole groups only, as rows come in order of the key

        def done(some: list[tuple]) -> pa.RecordBatch:
            out: list[tuple] = []
            for (a, b), part in _by_range(some):
                out += [(part[i][3], part[i][4], x, y) for i, x, y in shared_strings([r[5] for r in part], [r[6] for r in part], length, a, b, [r[0] for r in part])]
            g, f, x, y = zip(*out, strict=True) if out else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(f, pa.int64()), pa.array(x, pa.int32()), pa.array(y, pa.int32())], names=["g", "f", "first", "last"])

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("key", "a", "b", "g", "f", "left", "right")), strict=True)
            if len(held) > 20_000 and held[0][0] != held[-1][0]:
                cut = next(i for i in range(len(held) - 1, -1, -1) if held[i][0] != held[-1][0]) + 1
                yield done(held[:cut])
                held = held[cut:]
        yield done(held)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "g long, f long, first int, last int")


def _by_range(rows: list[tuple]) -> list[tuple[tuple[int, int], list[tuple]]]:
    """Rows by their ranges of offsets."""
    out: dict[tuple[int, int], list[tuple]] = {}
    for r in rows:
        out.setdefault((r[1], r[2]), []).append(r)
    return list(out.items())


def repeated(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """k1, k2, begin, end: covered byte ranges of every document (they may overlap)."""
    spark = docs.sparkSession
    bound_batches(spark)
    # most seeds occur once: what follows is about the others
    seeds = written(_seeds_of(docs, length, text).groupBy("g").agg(F.sum("n").alias("n")).where("n > 1").select("g"), "seeds")
    release(spark)
    every = written(_fragments_of(docs, length, doc_id, text).join(seeds, "g"), "repeats")
    dropped(seeds)
    release(spark)
    pairs = every.groupBy("g", "f").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "at", "back", "ahead")).alias("one"))
    counted = written(pairs.join(pairs.groupBy("g").agg(F.count("*").alias("m")), "g").select("g", "f", "n", "m", "one.*"), "fragments")

    # one copy of every fragment whose seed has others: cut its text out of its document
    wanted = counted.where("m > 1").groupBy("k1", "k2").agg(F.collect_list(F.struct("g", "f", "m", "at", "back", "ahead")).alias("cuts"))
    bodies = docs.select(F.col(text).cast("binary").alias("t"), *doc_key(doc_id, text)).join(wanted, ["k1", "k2"]).select("t", "cuts", F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.lit(0))).alias("copy")).where("copy = 1")
    piece = F.struct(
        F.col("c.g").alias("g"), F.col("c.f").alias("f"), F.col("c.m").alias("m"),
        F.substring("t", (F.col("c.at") - F.col("c.back") + 1).cast("int"), F.col("c.back")).alias("left"),
        F.substring("t", (F.col("c.at") + 1).cast("int"), F.col("c.ahead")).alias("right"),
    )
    texts = bodies.select("t", F.explode("cuts").alias("c")).select(piece.alias("p")).select("p.*")

    texts = written(texts, "texts")
    release(spark)
    easy = texts.where(F.col("m") <= hot).select(F.col("g").alias("key"), F.lit(0).alias("a"), F.lit(length - SEED).alias("b"), "g", "f", "left", "right")
    split, common = _split_hot(texts.where(F.col("m") > hot), length, hot)
    partial = _sorted_groups(easy.unionByName(split), length)

    ranges = partial.unionByName(common).groupBy("g", "f").agg(F.collect_list(F.struct("first", "last")).alias("some"))
    whole_ones = counted.where("n > 1").select("g", "f", F.lit(None).cast("array<struct<first:int,last:int>>").alias("some"))
    known = ranges.join(whole_ones.select("g", "f"), ["g", "f"], "left_anti").unionByName(whole_ones)

    known = written(known, "known")
    dropped(counted)
    release(spark)  # of the texts that were sorted

    every = every.join(known, ["g", "f"])
    all_of_it = F.array(F.struct((length - F.col("ahead")).cast("int").alias("first"), F.col("back").alias("last")))
    runs = every.select("k1", "k2", "at", F.explode(F.coalesce("some", all_of_it)).alias("r"))
    return runs.select("k1", "k2", (F.col("at") - F.col("r.last")).alias("begin"), (F.col("at") - F.col("r.first") + length).alias("end"))


def deduplicated(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, spans (array<struct<begin, end>> of removed bytes), kept (binary)."""
    packed = (F.col("begin") * (1 << 24) + (F.col("end") - F.col("begin"))).alias("p")
    gone = written(repeated(docs, length, doc_id, text, hot).select("k1", "k2", packed).groupBy("k1", "k2").agg(F.collect_set("p").alias("gone")), "gone")
    release(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    keyed = docs.select(F.col(doc_id).alias("d"), body.alias("t"), *doc_key(doc_id, text)).join(gone, ["k1", "k2"], "left").select("d", "t", "gone")
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            texts, spans = [], []
            for body_, listed in zip(batch.column("t").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                merged: list[list[int]] = []
                for p in sorted(listed or ()):
                    a, b = p >> 24, (p >> 24) + (p & ((1 << 24) - 1))
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                at, kept = 0, []
                for a, b in merged:
                    kept.append(body_[at:a])
                    at = b
                texts.append(b"".join([*kept, body_[at:]]))
                spans.append([{"begin": a, "end": b} for a, b in merged])
            sizes = pa.array([len(x) for x in batch.column("t").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("d"), sizes, pa.array(spans, span), pa.array(texts, pa.binary())], names=["d", "n_bytes", "spans", "kept"])

    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    return keyed.mapInArrow(run, f"d {kind}, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary").withColumnRenamed("d", doc_id)
