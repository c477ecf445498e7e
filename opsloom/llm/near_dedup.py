"""MinHash near-dedup (1): BagMinHash signatures, bands, verification of multiset overlap.

A document is the multiset of its five-word shingles. Its BagMinHash signature takes, for each
of SIZE components, the earliest point of Poisson processes that belong to (shingle, level):
the multiplicities are discretised into dyadic ranges of levels, a range of n levels has a
process of n times the rate, and a point is dropped if its level lies above the multiplicity.
Two components agree with the probability of the weighted Jaccard similarity. Points later
than all components could need are never drawn, so a document costs one draw a shingle and
a few hundred more.

Documents of equal words are one node. Bands of ROWS components make buckets, and each bucket
belongs to the family of one centre, its member that shares most buckets: the pairs of a bucket
lie in one family, and a family holds a node once however many bands they share. Every family
is resolved exactly, by multiset overlaps of whole texts:

* a family of at most CELL nodes and CELL_SHINGLES shingles is one group of a task, which
  finds all its links and returns a spanning forest of them;
* in a larger one the members, dealt over tasks by a salt, are first compared with the centre,
  and links join components. If more than one is left, its nodes are dealt into cells of half
  that size and every two cells make such a group. No pair is skipped, so no link of a bucket is lost;
  this last step costs a text a copy for each other cell of its family, and only families of
  over CELL different texts that their centre doesn't join come to it.

Edge cases: a text of one to four words is a single shingle; null, empty and wordless texts
are never near anything; documents with the same id and text are one document; a null id
takes part, and a class whose ids are all null has a null id; ties go to the smallest id.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Ranges, Runs, Words, bound_batches, dropped, flat, mix, pieces, unused, written
from .sentence_spans import doc_key

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 4
SIZE = BANDS * ROWS
MEMBERS_A_TASK = 500
#: Nodes and shingles of a family that one task resolves at once.
CELL, CELL_SHINGLES = 1024, 1 << 20
#: Shingles of more nodes of a group than this are counted by matrix products, the others pair by pair.
FREQUENT = 48
_HASH_BITS = np.uint64((1 << 54) - 1)


def shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words, np.ndarray]:
    """(document, 54-bit shingle hash, multiplicity) of a flat batch of up to 1024 texts; the words and their hashes."""
    words = Words(data, starts, ends)
    hashed, n = Ranges(data)(words.start, words.end), len(words.start)
    first = np.arange(n)
    left = words.first[words.doc] + words.per_doc[words.doc] - first  # words from here to the end of the text
    first = first[(left >= SHINGLE) | (first == words.first[words.doc])]
    size = np.minimum(words.first[words.doc[first]] + words.per_doc[words.doc[first]] - first, SHINGLE)
    h = mix(size.astype(np.uint64))
    for k in range(SHINGLE):
        h = np.where(size > k, mix(h ^ hashed[np.minimum(first + k, n - 1)]), h) if n else h
    keys = np.sort((words.doc[first].astype(np.uint64) << np.uint64(54)) | (h & _HASH_BITS))
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    count = np.diff(np.append(head, len(keys)))
    keys = keys[head]
    return (keys >> np.uint64(54)).astype(np.int64), keys & _HASH_BITS, count, words, hashed


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_minhash(doc: np.ndarray, h: np.ndarray, count: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """(n, size) signature values; a document without shingles has the largest value everywhere."""
    empty = np.uint64(2**64 - 1)
    out = np.full(n * size, empty)
    weight = np.bincount(doc, count, n)
    # ranges of levels: (0, 1], (1, 2], (2, 4], (4, 8] ...
    parts, low = [np.arange(len(doc))], 1
    levels = [np.zeros(len(doc), np.int64)]
    while len(big := np.flatnonzero(count > low)):
        parts.append(big)
        levels.append(np.full(len(big), low, np.int64))
        low *= 2
    element, base = np.concatenate(parts), np.concatenate(levels)
    width = np.maximum(base, 1)
    seed = mix(h[element] ^ (base.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    limit = np.where(weight > 0, (math.log(size) + 4) / np.maximum(weight, 1), 0.0)
    todo = np.arange(len(element))
    while len(todo):
        at, time, draw = todo, np.zeros(len(todo)), 0
        while len(at):
            step = mix(seed[at] + np.uint64(4 * draw + 1))
            time = time - np.log(_uniform(step)) / (size * width[at])
            live = time <= limit[doc[element[at]]]
            at, time, step = at[live], time[live], step[live]
            level = base[at] + 1 + (_uniform(mix(step ^ np.uint64(0xE7037ED1A0B428DB))) * width[at]).astype(np.int64)
            fits = level <= count[element[at]]
            component = (mix(step ^ np.uint64(0x8EBC6AF09C88C6E3)) % np.uint64(size)).astype(np.int64)
            np.minimum.at(out, (doc[element[at]] * size + component)[fits], time[fits].view(np.uint64))
            draw += 1
        short = (out.reshape(n, size) == empty).any(axis=1) & (weight > 0)  # rare: a component is still empty
        limit = np.where(short, limit * 2, 0.0)
        todo = np.flatnonzero(short[doc[element]])
    return out.reshape(n, size)


_SKETCH = "k1 long, k2 long, node binary, n int, bands array<long>"


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """d (doc_id), k1, k2, node (hash of the words), n (shingles) and bands of every text with words."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            data, starts, ends = flat(batch.column("t"))
            doc, h, count, words, hashed = shingles(data, starts, ends)
            n = len(starts)
            mixed = mix(bag_minhash(doc, h, count, n))
            bands = np.zeros((n, BANDS), np.uint64)
            for r in range(ROWS):
                bands = mix(bands + mixed[:, r::ROWS] + np.uint64(r))
            bands = mix(bands + np.arange(BANDS, dtype=np.uint64))
            node = np.column_stack(Runs(hashed, 2)(words.first, words.first + words.per_doc))
            keep = pa.array(np.flatnonzero(words.per_doc > 0))
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), n, [None, pa.py_buffer(np.ascontiguousarray(node))]).cast(pa.binary())
            lists = pa.ListArray.from_arrays(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32), bands.view(np.int64).ravel())
            size = pa.array(np.maximum(words.per_doc - SHINGLE + 1, 1).astype(np.int32))
            columns = [*(batch.column(c) for c in ("d", "k1", "k2")), raw, size, lists]
            yield pa.RecordBatch.from_arrays([c.take(keep) for c in columns], names=["d", "k1", "k2", "node", "n", "bands"])

    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    source = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"), *doc_key(doc_id, text))
    return source.mapInArrow(run, f"d {kind}, {_SKETCH}")


# ---------------------------------------------------------------- components
def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """node, label of the nodes of edges (u, v): the smallest node of each connected component.

    A step takes the smallest label of a node, its neighbours and the node that its label names, in one join and one
    aggregation; a star whose centre is its smallest node is done at once."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = written(both.unionByName(both.select("u", F.col("u").alias("v"))).distinct(), f"{name}-edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")), f"{name}0")
    step = 0
    while True:
        step += 1
        near = both.unionByName(labels.select(F.col("node").alias("u"), F.col("label").alias("v")))
        seen = near.join(labels.withColumnRenamed("node", "v"), "v")
        after = written(seen.groupBy(F.col("u").alias("node")).agg(F.min("label").alias("label"), F.max(F.when(F.col("u") == F.col("v"), F.col("label"))).alias("old")), f"{name}{step}")
        moved = after.where(F.col("old") != F.col("label")).limit(1).count()
        labels = after.select("node", "label")
        if not moved:
            return labels


# ---------------------------------------------------------------- verification
def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets given as (sorted hashes, counts)."""
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    both = a[0][at] == b[0]
    least = np.minimum(a[1][at[both]], b[1][both]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))


def forest(bags: list[tuple[np.ndarray, np.ndarray]], similarity: float = SIMILARITY, frequent: int = FREQUENT) -> np.ndarray:
    """For each multiset (hashes, counts) the first one of its component, where every two of at least `similarity` are linked."""
    m, size = len(bags), np.array([c.sum() for _, c in bags], np.float64)
    # the k-th occurrence of a shingle is an item of its own, so that multisets become sets
    row = np.repeat(np.arange(m), size.astype(np.int64))
    count = np.concatenate([c for _, c in bags])
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    item = np.repeat(np.concatenate([h for h, _ in bags]), count)
    item = np.where(nth == 0, item, mix(item ^ (nth.astype(np.uint64) << np.uint64(54))))
    order = np.argsort(item, kind="stable")
    item, row = item[order], row[order]
    head = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
    holders = np.diff(np.append(head, len(item)))
    both = np.zeros((m, m), np.float32)
    few = np.repeat((holders > 1) & (holders <= frequent), holders)
    near_row, near_item = row[few], item[few]
    for apart in range(1, frequent):
        same = np.flatnonzero(near_item[apart:] == near_item[:-apart])
        if not len(same):
            break
        np.add.at(both, (near_row[same], near_row[same + apart]), 1)
    both += both.T
    often = np.flatnonzero(holders > frequent)
    for begin in range(0, len(often), 2048):
        some = often[begin : begin + 2048]
        held = np.zeros((m, len(some)), np.float32)
        where = np.concatenate([np.arange(head[k], head[k] + holders[k]) for k in some])
        held[row[where], np.repeat(np.arange(len(some)), holders[some])] = 1
        both += held @ held.T
    linked = both.astype(np.float64) * (1 + similarity) >= similarity * (size[:, None] + size) - 1e-6
    np.fill_diagonal(linked, True)
    label = np.arange(m)
    while True:
        least = np.where(linked, label, m).min(axis=1)
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least


def _bags(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    doc, h, count, *_ = shingles(*flat(batch.column("t")))
    cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
    return [(h[a:b], count[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _stars(families: DataFrame, held: DataFrame) -> DataFrame:
    """Links (u, v) between the centres u of families (u, node, members) and their members."""
    member = families.where("u <> node").select("u", "node", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / MEMBERS_A_TASK)).cast("int").alias("salt"), F.lit(1).alias("role"))
    salts = F.sequence(F.lit(0), F.ceil(F.col("members") / MEMBERS_A_TASK).cast("int") - 1)
    centre = families.where("u = node").select("u", "node", F.explode(salts).alias("salt"), F.lit(0).alias("role"))
    dealt = held.join(member.unionByName(centre), "node").repartition("u", "salt").sortWithinPartitions("u", "salt", "role")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre_bag = None, None
        for part in pieces(batches, "t"):
            out: list[tuple[bytes, bytes]] = []
            for bag, u, node, salt, role in zip(_bags(part), *(part.column(c).to_pylist() for c in ("u", "node", "salt", "role")), strict=True):
                if role == 0:
                    key, centre_bag = (u, salt), bag
                elif key == (u, salt) and overlap(centre_bag, bag) >= SIMILARITY - 1e-9:
                    out.append((u, node))
            yield _pairs(out)

    return dealt.select("u", "node", "salt", "role", "t").mapInArrow(run, "u binary, v binary")


def _pairs(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    u, v = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])


def _within(families: DataFrame, held: DataFrame, cells: int) -> DataFrame:
    """Spanning links (u, v) of families (u, node, members, shingles), dealt into `cells` parts of a cell."""
    parts = F.greatest(F.ceil(F.col("members") * cells / CELL), F.ceil(F.col("shingles") * cells / CELL_SHINGLES), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("node", "u"), F.col("parts")).cast("int")
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: j != F.col("own")))
    roles = families.withColumn("parts", parts).withColumn("own", own).select("u", "node", "own", F.explode(others).alias("other"))
    roles = roles.select("u", "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    dealt = held.join(roles, "node").repartition("u", "i", "j").sortWithinPartitions("u", "i", "j", "node")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, bags = None, [], []

        def links() -> pa.RecordBatch:
            first = forest(bags) if len(bags) > 1 else range(len(bags))
            return _pairs([(nodes[a], v) for a, v in zip(first, nodes, strict=True) if nodes[a] != v])

        for part in pieces(batches, "t"):
            for bag, node, *group in zip(_bags(part), *(part.column(c).to_pylist() for c in ("node", "u", "i", "j")), strict=True):
                if group != key:
                    yield links()
                    key, nodes, bags = group, [], []
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    bags.append(bag)
        yield links()

    return dealt.select("u", "node", "i", "j", "t").mapInArrow(run, "u binary, v binary")


# ---------------------------------------------------------------- the operator
def _families(nodes: DataFrame) -> DataFrame:
    """u, node, members, shingles: the nodes that share a bucket whose centre is u, u itself among them."""
    placed = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = placed.groupBy("band", "bucket").agg(F.count("*").alias("many")).where("many > 1")
    placed = written(placed.join(shared, ["band", "bucket"]), "placed")
    # the text that others were made from shares the largest buckets with them: it has the greatest weight, in every band
    weight = placed.groupBy("node").agg(F.sum("many").alias("weight"))
    weighed = written(placed.drop("many").join(weight, "node"), "weighed")
    dropped(placed)
    centre = weighed.groupBy("band", "bucket").agg(F.min(F.struct(-F.col("weight"), "node")).alias("c")).select("band", "bucket", F.col("c.node").alias("u"))
    met = weighed.join(centre, ["band", "bucket"]).select("u", "node").distinct()
    met = written(met.join(nodes.select("node", "n"), "node"), "met")
    dropped(weighed)
    sizes = met.groupBy("u").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    out = written(met.drop("n").join(sizes, "u"), "families")
    dropped(met)
    return out


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows of sketches(), labels of the nodes that have links)."""
    found = written(sketches(docs, doc_id, text), "sketches")
    nodes = written(found.groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("one"), F.first("n").alias("n"), F.first("bands").alias("bands")), "nodes")
    families = _families(nodes)
    # the only time that texts of all documents move
    wanted = families.select("node").distinct().join(nodes, "node").select("node", F.col("one.k1").alias("k1"), F.col("one.k2").alias("k2"))
    held = written(docs.select(F.col(text).alias("t"), *doc_key(doc_id, text)).join(wanted, ["k1", "k2"]).select("node", "t"), "held")
    dropped(nodes)
    small = (F.col("members") <= CELL) & (F.col("shingles") <= CELL_SHINGLES)
    edges = written(_within(families.where(small), held, 1).unionByName(_stars(families.where(~small), held)), "links")
    labels = components(edges)
    # a larger family that still has several components is compared in full
    large = families.where(~small).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = large.groupBy("u").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("u")
    rest = written(large.join(mixed, "u").select("u", "node", "members", "shingles"), "rest")
    if rest.limit(1).count():
        more = written(_within(rest, held, 2), "more")
        labels = components(edges.unionByName(more))
    for done in (families, held, rest):
        dropped(done)
    return found, labels


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """d, k1, k2, class (binary): the class of every text with words."""
    found, labels = linked(docs, doc_id, text)
    return found.select("d", "k1", "k2", "node").join(labels, "node", "left").select("d", "k1", "k2", F.coalesce("label", "node").alias("class"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, class_id (the smallest doc_id of its class) and class_size."""
    of = written(classes(docs, doc_id, text), "classes")
    # written, so that the join below has no aggregation in its stage and Spark can split a class of a third of all rows
    sizes = written(of.groupBy("class").agg(F.min("d").alias("class_id"), F.count("*").alias("class_size")), "sizes")
    worded = of.join(sizes, "class").select(F.col("d").alias(doc_id), "class_id", "class_size")
    empty = docs.where(~F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).select(doc_id, F.col(doc_id).alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return worded.unionByName(empty)


def one_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each class (the one with the smallest id), all columns."""
    of = classes(docs, doc_id, text)
    k1, k2 = unused(docs, "_k1", "_k2")
    first = of.groupBy("class").agg(F.min(F.struct(F.col("d").isNull(), "d", "k1", "k2")).alias("w")).select(F.col("w.k1").alias(k1), F.col("w.k2").alias(k2))
    keyed = docs.select("*", *(k.alias(n) for k, n in zip(doc_key(doc_id, text), (k1, k2), strict=True)))
    worded = keyed.where(F.col(text).rlike(r"[^\x20\x09-\x0D]")).join(first, [k1, k2]).dropDuplicates([k1, k2]).select(docs.columns)
    return worded.unionByName(docs.where(~F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))))
