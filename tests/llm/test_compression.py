import numpy as np
from opsloom.llm import compression as c


def test_held_out_accuracy_and_edges(spark, clashing, nothing):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = c.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    small = labels.where("doc_id < 3000")
    out = c.score(clashing, small.unionByName(small.select("doc_id", "quality", "toxic"))).collect()
    assert len(out) == clashing.count() and all(0 <= r.score <= 1 for r in out)
    assert c.score(nothing, labels).count() == 0
    none = c.score(clashing, labels.where("quality = 1")).collect()
    assert {r.score for r in none} == {0.0, 0.5} and {r.score for r in none if r.doc_id in (1, 2, 3)} == {0.0}


def test_whole_texts_count():
    model = c.Model(b"good words " * 200, b"### bad " * 200)
    short, long_one = c.measure([b"x" * 100, b"x" * 100_000], model.compressors())
    assert long_one[0] == 100_000 and long_one[1] > 10 * short[1]


def test_scores_by_hand(spark):
    """Sizes from compressors made anew for every chunk, and the logistic of the features written out."""
    import math

    import zstandard

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = c.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.where("doc_id % 29 = 0").collect()}

    def size(chunk, dictionary):
        held = zstandard.ZstdCompressionDict(dictionary)
        return len(zstandard.ZstdCompressor(level=c.LEVEL, dict_data=held, write_content_size=False, write_dict_id=False, write_checksum=False).compress(chunk))

    def score(text):
        if not (text or "").strip():
            return 0.0
        raw = text.encode()
        chunks = [raw[i : i + 2048] for i in range(0, len(raw), 2048)]
        good, bad = sum(size(x, model.good) for x in chunks), sum(size(x, model.bad) for x in chunks)
        d, r = min(3, max(-3, 10 * (bad - good) / (bad + good))), math.log(good / len(raw))
        x = [1, d, r, max(-1 - r, 0), max(-1.4 - r, 0), max(-1.8 - r, 0), max(d - 0.5, 0), max(-0.5 - d, 0)]
        return 1 / (1 + math.exp(-min(30, max(-30, sum(a * b for a, b in zip(x, model.weights, strict=True))))))

    got = {r.doc_id: (r.score, r.predicted) for r in c.score(docs, labels).where("doc_id % 29 = 0").collect()}
    assert got.keys() == texts.keys() and len(got) > 20
    for i, (s, predicted) in got.items():
        assert abs(s - score(texts[i])) < 1e-9 and predicted == (s >= 0.3)
