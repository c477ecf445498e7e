import gzip
import hashlib
import io
import random

from opsloom.llm import warc


def test_round_trip_and_revisits(spark, tmp_path):
    long_one, draw = "é" * 60, random.Random(2)
    rows = [(i, f"http://x/{i}\n", "".join(draw.choice("ab<>é") for _ in range(draw.randint(0, 3000)))) for i in range(200)]
    rows += [(300, None, None), (301, "u", ""), (302, "u", long_one), (303, "u", long_one), (303, "u", long_one), (299, "u", long_one), (None, "u", long_one), (304, "u", "s" * 99), (305, "u", "s" * 99)]
    rows += [(306, "u", "s" * 100), (307, "u", "s" * 100), (308, "big", "x y " * 400_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    files = warc.write(warc.revisits(pages), str(tmp_path))
    assert sum(n for *_, n in files) == len(rows)
    for split in (1000, 1 << 20):
        got = warc.read(spark, [f[:2] for f in files], split).collect()
        assert len(got) == len(rows)
        by_id = {(r.page_id, r.payload_bytes): r for r in got}
        for i, _, html in rows:
            body = (html or "").encode()
            r = by_id[i, len(body)]
            assert r.payload_digest == hashlib.sha256(body).hexdigest()
            first = {long_one: 299, "s" * 100: 306}.get(html)
            assert r.refers_to == (None if first in (None, i) else first) and r.record_type == ("response" if r.refers_to is None else "revisit")
            assert r.payload == (body if r.refers_to is None else None)


def test_magic_inside_a_member_is_not_a_record():
    inner = gzip.compress(b"not a record")
    raw = warc.record(1, "u", inner * 50, hashlib.sha256(inner * 50).hexdigest(), None)
    import zlib

    pack = lambda x, level: (gz := zlib.compressobj(level, zlib.DEFLATED, 31)).compress(x) + gz.flush()
    data = pack(raw, 0) + warc.MAGIC + b"junk" + pack(raw, 9)
    for split in (7, 100, 10_000):
        got = [x for s in range(0, len(data), split) for x in warc.members(io.BytesIO(data), len(data), s, s + split)]
        assert [g for _, g in got] == [raw, raw]


def test_empty_table(spark, tmp_path):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path)).count() == 0
