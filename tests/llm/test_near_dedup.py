import random
import re
from collections import Counter

import numpy as np
from opsloom.llm import near_dedup as n
from opsloom.llm.common import flat


def bag(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def brute(rows):
    """Smallest id of every row's class: components of similarity 0.8 or more."""
    bags, parent = [bag(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values()):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
    return [d if not bags[i] else least[find(i)] for i, (d, _) in enumerate(rows)]


def chained():
    """Copies that resemble the text they were made from, but hardly each other; the original has a late id."""
    draw = random.Random(9)
    base = [f"w{draw.randrange(500)}" for _ in range(400)]
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(9):
            t[draw.randrange(len(t))] = f"z{draw.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    rows.append((500, " ".join(base)))
    return rows + [(600 + i, " ".join(f"q{draw.randrange(3000)}" for _ in range(200))) for i in range(40)]


def test_matches_brute_force(spark, awkward, clashing, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    want = sorted((str(d), str(c)) for (d, _), c in zip(rows, brute(rows), strict=True))
    for docs in (awkward, clashing):
        assert sorted((str(r.doc_id), str(r.class_id)) for r in n.groups(docs).collect()) == want
    assert n.groups(nothing).count() == 0 and n.one_each(nothing).count() == 0
    kept = n.one_each(clashing)
    assert kept.columns == clashing.columns
    assert len({c for _, c in want if c != "None"} - {str(d) for d, t in rows if not bag(t)}) <= kept.count() <= len(rows)


def test_no_link_is_lost(spark):
    rows = chained()
    got = {r.doc_id: r.class_id for r in n.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[d] for d, _ in rows] == brute(rows)


def test_signature_estimates_weighted_similarity():
    draw = random.Random(2)
    a = [draw.choice("abcdef") + str(draw.randrange(6)) for _ in range(300)]
    b = a[:200] + [draw.choice("ghij") for _ in range(100)]
    import pyarrow as pa

    texts = [" ".join(a), " ".join(b)]
    doc, h, count, *_ = n.shingles(*flat(pa.array(texts)))
    sizes = np.array([n.bag_minhash(doc, n.mix(h + np.uint64(k)), count, 2, 64) for k in range(60)])
    x, y = bag(texts[0]), bag(texts[1])
    true = sum((x & y).values()) / sum((x | y).values())
    assert abs((sizes[:, 0] == sizes[:, 1]).mean() - true) < 0.03
    # repeated shingles: weights of 1 to 9
    doc, h, count = np.array([0, 0, 1, 1, 1]), np.array([5, 9, 5, 9, 11], np.uint64), np.array([9, 2, 4, 3, 1])
    sizes = np.array([n.bag_minhash(doc, n.mix(h + np.uint64(100 + k)), count, 2, 64) for k in range(60)])
    assert abs((sizes[:, 0] == sizes[:, 1]).mean() - 6 / 13) < 0.03


def test_large_families_are_compared_in_full(spark, monkeypatch):
    """With cells of a few nodes every family goes through stars and pairs of cells."""
    rows = chained()
    draw = random.Random(4)
    base = [f"v{draw.randrange(300)}" for _ in range(300)]
    for i in range(60):  # some of these resemble each other, but not the centre
        t = list(base)
        for k in range(6 * (i % 3)):
            t[(k * 37 + i % 5) % 300] = f"y{k}"
        rows.append((800 + i, " ".join(t) + f" tail{i}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for cell in (16, 40):
        monkeypatch.setattr(n, "CELL", cell)
        monkeypatch.setattr(n, "MEMBERS_A_TASK", 7)
        got = {r.doc_id: r.class_id for r in n.groups(docs).collect()}
        assert [got[d] for d, _ in rows] == want


def test_forest_of_multisets():
    draw = random.Random(6)
    for frequent in (1, 4, 48):
        sets = [Counter(draw.choices(range(30), k=draw.randint(1, 60))) for _ in range(60)]
        for i in range(30):  # near copies, heavier or lighter by a little
            copy = Counter(sets[i])
            copy.update(draw.choices(range(40), k=draw.randint(0, 9)))
            sets.append(copy)
        keys = np.random.default_rng(1).integers(0, 1 << 54, 40).astype(np.uint64)
        bags = [(keys[list(c)], np.array(list(c.values()))) for c in sets]
        parent = list(range(len(sets)))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for i in range(len(sets)):
            for j in range(i):
                if sum((sets[i] & sets[j]).values()) * 5 >= 4 * sum((sets[i] | sets[j]).values()):
                    a, b = sorted((find(i), find(j)))
                    parent[b] = a
        assert n.forest(bags, frequent=frequent).tolist() == [find(i) for i in range(len(sets))]


def test_recall_of_a_whole_table(spark):
    """Every link of sf0.01, counted by brute force over an index of shingles, lies within a class."""
    rows = [(r.doc_id, bag(r.text)) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows = [(d, b) for d, b in rows if b]
    holders, shared = {}, Counter()
    for i, (_, b) in enumerate(rows):
        for shingle, c in b.items():
            for j, other in holders.setdefault(shingle, []):
                shared[j, i] += min(c, other)
            holders[shingle].append((i, c))
    size = [sum(b.values()) for _, b in rows]
    links = [(rows[i][0], rows[j][0]) for (i, j), o in shared.items() if 9 * o >= 4 * (size[i] + size[j])]
    got = {r.doc_id: r.class_id for r in n.groups(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert len(links) > 100 and sum(got[a] == got[b] for a, b in links) == len(links)


def test_columns_named_as_its_own(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", 1, 2), (2, "a b c d e f", 3, 4)], "doc_id long, text string, _k1 int, _K2 int")
    assert [tuple(r) for r in n.one_each(rows).collect()] == [(1, "a b c d e f", 1, 2)]
