import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F
from opsloom.llm import decontaminate as d
from opsloom.llm.queries import op4_decontamination


def brute(text, items, window=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, body in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), body or ""))
        n = min(window, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


def test_index_against_naive_search(monkeypatch):
    draw = random.Random(3)
    codes = np.concatenate([[0], *[[*(draw.choice([1, 1, 2, 3]) for _ in range(draw.randint(1, 60))), 0] for _ in range(40)]]).astype(np.int64)
    index = d.FMIndex(codes, 4)
    for n in (1, 2, 5):
        patterns = np.array([[draw.choice([1, 2, 3]) for _ in range(n)] for _ in range(40)], np.int64)
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high, strict=True):
            want = [i for i in range(len(codes) - n + 1) if (codes[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_report_matches_brute_force(spark, awkward, clashing, nothing, monkeypatch):
    texts = {r.doc_id: r.text for r in awkward.collect()}
    seven = texts[7].split()
    items = [(1, " ".join(seven[100:150])), (2, "the of"), (2, "beta BETA"), (3, None), (4, ""), (None, "x1 x1 x1"), (5, "  ".join(seven[140:170]).upper()), (6, "🙂")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for docs in (awkward, clashing):
        rows = d.report(docs, benchmark).collect()
        assert len(rows) == awkward.count()
        for r in rows:
            n, hit, found = brute(texts[r.doc_id], items)
            assert (r.n_words, r.n_hit, sorted(r["items"])) == (n, hit, found), r.doc_id
            assert r.contaminated == (hit > 0 and 20 * hit >= n)
    assert d.report(nothing, benchmark).count() == 0
    assert d.report(awkward, benchmark.limit(0)).where("n_hit > 0").count() == 0
    kept = d.clean(clashing, benchmark)
    assert kept.columns == clashing.columns and kept.count() == sum(not r.contaminated for r in rows)


def test_long_runs_and_several_blocks(spark, awkward, monkeypatch):
    """Runs longer than an index are cut with an overlap; several broadcasts add up."""
    monkeypatch.setattr(d, "SHARD", 64)
    text = " ".join(random.Random(1).choice("ab") for _ in range(3000)).encode()
    items = [(i, " ".join(random.Random(i).choice("ab") for _ in range(20))) for i in range(200)] + [(900, text.decode()[500:560])]
    one = d.block_of(items)
    spans, found = d.occurrences([d.WORD.findall(text)], one)
    n, hit, want = brute(text.decode(), items)
    assert sum(b - a for a, b in spans[0]) == hit and sorted(one.items[k] for k in found[0]) == want
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert d.block_count(benchmark, size=1000) > 3
    rows = [(1, text.decode()), (1, text.decode()), (2, "zz"), (3, None), (None, items[0][1] + " c " + items[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_k1", F.lit("mine"))
    key = lambda r: (str(r.doc_id), r.n_words, r.n_hit, [tuple(x) for x in r.spans], r["items"], r.contaminated)
    whole, parts = (sorted(map(key, d.report(docs, benchmark, block_bytes=size).collect())) for size in (1 << 20, 1500))
    assert whole == parts and len(whole) == 5
    kept = [sorted(map(str, d.clean(docs, benchmark, block_bytes=size).collect())) for size in (1 << 20, 1500)]
    assert kept[0] == kept[1] and len(kept[0]) == 2


def test_query_digest(spark):
    row = next(r for r in op4_decontamination(spark, "/root/testdata/sf0.001").collect() if r.n_items == 0)
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest()
