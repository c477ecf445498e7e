import random
import tracemalloc

import numpy as np
import pytest
from opsloom.llm import suffix_dedup as s
from opsloom.llm.common import Rolling


def brute(texts, length=200):
    """(removed bytes as a mask) of every text."""
    seen = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen.setdefault(t[p : p + length], []).append((i, p))
    masks = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                masks[i][p : p + length] = True
    return masks


def corpus():
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = prose(300), prose(60)
    texts = [None, "", "x", "a" * 199, "a" * 200, "a" * 450, "ab" * 300, base, base, base[:700] + "!" + base[700:], base[50:], prose(200) + passage + prose(100), passage + prose(50)]
    texts += [prose(20) + passage[: draw.randint(150, 400)] + prose(20) for _ in range(60)]
    for _ in range(25):  # near copies: a byte changed here and there
        t = list(base)
        for _ in range(draw.randint(1, 6)):
            t[draw.randrange(len(t))] = "Z"
        texts.append("".join(t))
    return texts


@pytest.mark.parametrize("hot", [s.HOT, 3])
def test_matches_brute_force(spark, hot):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    raw = [(t or "").encode() for t in texts]
    want = brute(raw)
    rows = s.deduplicated(docs, hot=hot).collect()
    assert len(rows) == len(texts)
    for r in rows:
        mask = np.zeros(len(raw[r.doc_id]), bool)
        for a, b in r.spans:
            assert a < b and not mask[a : b + 1].any()
            mask[a:b] = True
        assert r.n_bytes == len(mask) and (mask == want[r.doc_id]).all(), r.doc_id
        assert bytes(r.kept) == np.frombuffer(raw[r.doc_id], np.uint8)[~mask].tobytes()


def test_edges(awkward, clashing, nothing):
    assert s.deduplicated(nothing).count() == 0
    rows = awkward.collect()
    want = {}
    for r, mask in zip(rows, brute([(r.text or "").encode() for r in rows]), strict=True):
        want.setdefault(r.doc_id, []).append(int(mask.sum()))
    for docs in (awkward, clashing):
        got = {}
        for r in s.deduplicated(docs).collect():
            got.setdefault(r.doc_id, []).append(sum(b - a for a, b in r.spans))
        assert got == want


def test_deep_shallow_sorts():
    draw = random.Random(4)
    rows = np.array([[draw.choice((0, 97, 98)) for _ in range(70)] for _ in range(60)] + [[97] * 40 + [draw.choice((97, 255)) for _ in range(30)] for _ in range(200)], np.uint8)
    rows = np.concatenate([rows, rows[::7]])
    order, common = s.deep_shallow(rows, 16)
    ordered = [rows[i].tobytes() for i in order]
    assert ordered == sorted(ordered)
    for a, b, n in zip(ordered, ordered[1:], common[1:], strict=False):
        assert n == next((i for i in range(70) if a[i] != b[i]), 70)


def test_a_seed_with_very_many_surroundings(spark):
    """A line that thousands of documents hold, each with something else around it: its seeds are dealt by what stands around them."""
    draw = random.Random(3)
    line = "This licence line is in every document, whatever else it says; it is longer than a hundred and fifty bytes, so that strings of two hundred reach into what differs around it. "
    noise = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    tails = [noise(40) for _ in range(30)]
    texts = [noise(80) + line + draw.choice(tails) + noise(60) for _ in range(1500)]
    raw = [t.encode() for t in texts]
    want = [int(m.sum()) for m in brute(raw)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    for hot in (s.HOT, 64):
        got = {r.doc_id: sum(b - a for a, b in r.spans) for r in s.deduplicated(docs, hot=hot).collect()}
        assert [got[i] for i in range(len(texts))] == want and sum(want) > 100_000


def test_memory_of_a_batch(monkeypatch):
    """A batch is cut into blocks: they change no fragment, and four million bytes take less than 200 MB at once."""
    draw = np.random.default_rng(3)
    data = draw.choice(np.frombuffer(b"abcdefgh \n", np.uint8), 4 << 20)
    at = np.sort(np.append(draw.integers(0, len(data), 900), [0, 500, 1000]))
    starts, ends = at, np.append(at[1:], len(data))
    tracemalloc.start()
    whole = s.fragments(data, starts, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6, peak
    cut = slice(0, 60)
    some = s.fragments(data[: ends[59]], starts[cut], ends[cut])
    monkeypatch.setattr(s, "BLOCK", 777)
    blocks = s.fragments(data[: ends[59]], starts[cut], ends[cut])
    for name in some:
        assert (some[name] == blocks[name]).all() and (some[name] == whole[name][whole["doc"] < 60]).all(), name


def test_memory_of_a_long_text(monkeypatch):
    """Hashes too are made a block at a time: a text that fills a batch by itself takes a few bytes a byte, and hashes tell nothing of its blocks."""
    draw = np.random.default_rng(4)
    data = draw.choice(np.frombuffer(b"abcdefgh \n", np.uint8), 8 << 20)
    tracemalloc.start()
    whole = s.fragments(data, np.zeros(1, np.int64), np.array([len(data)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6, peak
    assert (whole["g"].view(np.uint64) == Rolling(data)(whole["at"], whole["at"] + s.SEED)).all()
    text = np.tile(data[:5000], 3)
    few = s.fragments(text, np.zeros(1, np.int64), np.array([len(text)]))
    monkeypatch.setattr(s, "BLOCK", 301)
    blocks = s.fragments(text, np.zeros(1, np.int64), np.array([len(text)]))
    for name in few:
        assert (few[name] == blocks[name]).all(), name
    assert len(np.unique(few["f"])) < len(few["f"]) / 2
