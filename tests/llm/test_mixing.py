import re
from collections import defaultdict

import pytest
from opsloom.llm import mixing


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, capped, rest = {}, set(), float(sum(sizes.values()))
    while True:
        total = sum(weight[s] for s in order if s not in capped)
        left = rest - sum(3 * sizes[s] for s in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / total for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("parts", [1, 7])
def test_targets_and_balance(awkward, parts):
    rows = mixing.mix(awkward.repartition(parts)).collect()
    docs = awkward.collect()
    assert len(rows) == len(docs)
    sizes = defaultdict(int)
    for r in docs:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = brute_targets(sizes)
    assert sorted({(r.source_size, round(r.target, 6)) for r in rows}) == sorted({(sizes[s], round(t, 6)) for s, t in want.items()})
    taken = defaultdict(int)
    for r in rows:
        assert r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        taken[r.source_size, round(r.target, 6)] += r.taken
    largest = max(r.size for r in rows)
    for (size, target), words in taken.items():
        assert abs(words - target) <= largest, (size, target, words)


def test_reruns_agree(clashing):
    runs = [sorted(map(str, mixing.mix(clashing.repartition(n)).collect())) for n in (1, 5)]
    assert runs[0] == runs[1]


def test_several_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 50)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    docs = spark.createDataFrame([(i, "w " * (i * 7919 % 97 + 1), "abcde"[i % 5] if i % 3 else "a") for i in range(3000)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).groupBy("source_size", "target").agg({"taken": "sum"}).collect()
    assert len(rows) == 5 and all(abs(r[2] - r.target) <= 97 for r in rows)


def test_empty_and_wordless(spark, nothing):
    assert mixing.mix(nothing).count() == 0
    rows = mixing.mix(spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2
