import re
from collections import Counter

import numpy as np
from opsloom.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    found, covered, seen, again = Counter(zip(words, words[1:], words[2:], strict=False)), set(), set(), 0
    for i in range(len(words) - 2):
        if found[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_counts_match_brute_force(awkward, clashing):
    for docs in (awkward, clashing):
        got = sorted(tuple(r)[:6] for r in q.statistics(docs).toLocalIterator() if r.doc_id is not None)
        want = sorted((r.doc_id, *brute(r.text)) for r in awkward.collect() if r.doc_id is not None)
        assert got == want


def test_empty_table_and_no_labels(spark, awkward, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.judge(nothing, labels).count() == 0
    rows = q.judge(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(r.kept != r.base_failed for r in rows)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    from opsloom.llm.common import held_out

    rows = q.judge(docs, labels).join(labels, "doc_id").where(held_out()).select("score", "quality").collect()
    assert np.mean([(r.score >= 0.3) == r.quality for r in rows]) > 0.95


def test_monotone_features():
    draw = np.random.default_rng(1)
    x = draw.random((3000, 3))
    y = (x[:, 0] + 0.3 * draw.standard_normal(3000) > 0.5).astype(float)
    y[x[:, 0] > 0.9] = 0  # against the direction asked for
    trees = q.fit(x, y, [1, 0, -1])
    line = np.linspace(0, 1, 200)
    for j, sign in ((0, 1), (2, -1)):
        for _ in range(5):
            at = np.tile(draw.random(3), (200, 1))
            at[:, j] = line
            assert (sign * np.diff(trees.margin(at)) >= -1e-12).all()


def test_patterned_lines_and_words_differ():
    import pyarrow as pa
    from opsloom.llm.quality_rules import text_statistics

    from .conftest import thue_morse

    for size in (128, 2048, 4096):
        x, y = ("".join(t) for t in thue_morse("a", "b", size))
        got = text_statistics(pa.array([f"{x}\n{y}", f"{x}\n{y}\n{x}", f"{x} 1 2 {y} 1 2 {x} 1 2"]))
        assert got["n_dup_lines"].tolist() == [0, 1, 0] and got["n_repeat_words"].tolist() == [0, 0, 6]


def by_hand(text):
    """The features of a text, written out."""
    import math

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars, symbols, dup, repeated = brute(text)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in text.split("\n"))
    rate = lambda pattern: len(re.findall(pattern, text)) / max(chars, 1)
    per = 1 / max(n, 1)
    return [
        math.log1p(n), chars * per, symbols * per, dup / max(lines, 1), repeated * per, rate("[A-Z]"), rate("[0-9]"), rate("[!?]"), rate("[|]"), n / max(lines, 1), len(set(words)) * per, text.count(".") * per,
    ]


def test_verdicts_by_hand(spark):
    """Every feature, every tree and the verdict of sf0.001 in plain Python; the filter keeps the same rows."""
    import math

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    trees = q.train(q.statistics(docs), labels)
    stats = {r.doc_id: r.features for r in q.statistics(docs).collect()}

    def leaf(x, at):
        while trees.left[at] != at:
            at = trees.left[at] if x[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
        return trees.value[at]

    kept = {r.doc_id: (r.score, r.kept) for r in q.judge(docs, labels).collect()}
    for r in docs.collect():
        text = r.text or ""
        x = by_hand(text)
        assert np.allclose(stats[r.doc_id], x, rtol=1e-12, atol=1e-12), r.doc_id
        n, *_, repeated = brute(text)
        score = 1 / (1 + math.exp(-(trees.base + sum(leaf(x, root) for root in trees.roots))))
        assert abs(kept[r.doc_id][0] - score) < 1e-9
        assert kept[r.doc_id][1] == (n >= 50 and 100 * repeated <= 50 * n and score >= 0.3)
    assert {r.doc_id for r in q.kept(docs, labels).collect()} == {i for i, (_, k) in kept.items() if k}
