import hashlib

import pytest
from opsloom.functions import classify as c
from opsloom.functions import signature as s
from opsloom.functions import textnorm
from opsloom.functions import textnorm as t
from pyspark.sql import functions as F

#: Published signature vectors: source, fields, digest.
VECTORS = [
    ("psi", ["cpu", "some", "b3"], "d8d1d8cc6f8c431d1b99197c3a52134a0a7d037e8ab9aa3bce221bbf5ddc7296"),
    ("journald", ["payment-worker", "queue wedge: pool exhausted, retry # in # ms"], "8721b2ea46c6cf26b09fe04f73f41b05fe3660e5c21ddefdbae6686708a13e4a"),
    ("dbus", ["user:1000", "payment-worker.service", "auto-restart"], "2b180920160f1ea8a68a3cd63856212c1e78d01abc9e18572b5d0be76f7cea3e"),
    ("disk", ["/", "free_pct"], "ca5ae505ad8384448d929b5e4a8d7414f8d77db1973115723736c5ce25138936"),
    ("timers", ["backup.timer", "missed"], "e529b7377e31655e90f5987023d0d8bb626616b41605939cd6b2e6429877dcc5"),
    ("inotify", ["/etc/payment/config.toml", "modify"], "7ebd19985bf29592ac9e990c0703028cb3ad0fa4f32a983cc53fb47c62939c2f"),
    ("sentinel", ["1", "worker.claim", "queue-wedge"], "18b12eea8a3929236822338d1b8d04055a2a670104b97782356e1559fc83f385"),
    ("generic", ["1", "legacy-cron", "connection refused to db host #.#.#.#:#"], "f464cc58cfa080a66693c8cf2ae5898d76a74a1d9fbc65f62f685ba67fca616b"),
    ("unknown", ["17d04f75658547e6"], "b52b9311988a6ef45221311ebebc52a0ed24016b9089bfeab674baae7a084b2e"),
]


@pytest.fixture
def value(spark):
    return lambda column: spark.range(1).select(column.alias("x")).first().x


def test_signature_vectors(value):
    for source, fields, digest in VECTORS:
        lits = [F.lit(x) for x in fields]
        assert value(s.digest(s.canonical(source, *lits))) == digest
        assert value(s.signature(source, *lits)) == f"{source}:sha256v1:{digest[:16]}"
    assert value(s.parsed(F.lit("psi:sha256v1:d8d1d8cc6f8c431d"))).source == "psi" and value(s.parsed(F.lit("x:sha256v1:d8d1d8cc6f8c431d"))) is None
    assert value(s.merge_key(F.lit("a\x00b "), F.lit("/"))) == hashlib.sha256(b"merge.v1\x1fa b\x1f/\x1e").hexdigest()[:16]
    assert value(s.group_key(F.lit(""), F.lit("k"), F.lit("s"))) == "mk:k"


def test_message_normalisation(value):
    cases = {
        "\n\nretry 12 in 0xFF ms\n  id deadbeef01\nc\nd": "retry # in <hex> ms\nid <h>\nc",
        "u 123e4567-e89b-12d3-a456-426614174000  x": "u <uuid> x",
        "é" * 400: "é" * 256,
        "z" * 511 + "é": "z" * 511,
        "z" * 510 + "日": "z" * 510,
        "z" * 509 + "🙂": "z" * 509,
    }
    for text, want in cases.items():
        assert value(t.message_norm(F.lit(text))) == want
    assert value(t.mask_message(F.lit("2024-01-02T03:04:05Z pid 77 /var/log/app/x.log 1234567"))) == "<ts> pid=<n> x.log <n>"
    assert value(t.mask_line(F.lit("src/a/b.go:12:3 goroutine 7 took 15ms at 0xDEADBEEF :8080  n=1234"))) == "b.go:LINE goroutine N took DUR at 0xADDR :PORT n=N"
    assert value(t.mask_text(F.lit(" a 100 \r\n b "))) == "a N\nb"
    assert value(t.base_name(F.lit("/a/b//"))) == "b" and value(t.file_stem(F.lit("/x/y.tar.gz"))) == "y.tar" and value(t.file_stem(F.lit(".env"))) == ".env"
    assert value(t.kebab(F.lit(" A b__C! "))) == "a-b-c" and value(t.cut_at_dash(F.lit("abc-def-ghi"), 9)) == "abc-def"
    assert value(t.entropy(F.lit("aabb"))) == 1.0 and value(t.chunks(F.array(*map(F.lit, [3, 3, 5, 9, 1])), 8)) == [0, 0, 1, 2, 3]


def test_classes(value):
    assert [value(c.pressure_bucket(F.lit(x))) for x in (9.99, 10.0, 25.0, 50.0)] == ["b1", "b2", "b3", "b4"]
    assert [value(c.missed_bucket(F.lit(x))) for x in (-1, 1, 4, 9, 10)] == ["0", "1", "2-4", "5-9", "10+"]
    assert [value(c.priority_name(F.lit(x))) for x in (0, 3, 7, 9)] == ["emerg", "err", "debug", "debug"]
    assert value(c.merge_class(F.lit("disk"), F.lit("io_error"))) == "io_stall" and value(c.merge_class(F.lit("dbus"), F.lit("failed"))) == "crash_loop"
    assert value(c.zone(F.lit("192.168.1.1"))) == "lan" and value(c.zone(F.lit("8.8.8.8"))) == "public" and value(c.exempt_address(F.lit("169.254.0.1")))
    assert value(c.unit_of_object_path(F.lit("/org/x/unit/pay_2dw_2eservice"))) == "pay-w.service" and value(c.escape_unit(F.lit("a-b.é"))) == "a_2db_2e_c3_a9"
    assert value(c.collapse_instance(F.lit("x@12-3.service"))) == "x@service" or value(c.collapse_instance(F.lit("x@12"))) == "x@"
    pairs = {("1.2", "1.10"): -1, ("v2.4.1", "2.4.1"): 0, ("1.0", "1.0.1"): None, ("", "1"): None, ("a", "b"): -1, ("1.x", "1.2"): None, ("3", "2"): 1}
    for (a, b), want in pairs.items():
        assert value(c.compare_releases(F.lit(a), F.lit(b))) == want
    assert value(c.fnv1a(F.lit("hello"))) == 0x4F9F2CAB and c.go_duration("1h30m") == 5400 and c.go_duration("x") == 0
    assert value(s.taxonomy_of(F.lit("dial tcp: i/o timeout"), c.TAXONOMY)) == "network_timeout"
    assert value(s.sampled(F.lit("abc"), 1)) is True


def test_paths_of_any_length(spark):
    """Masks of paths against the same in plain Python, whose patterns have no stack to overflow; and very long ones."""
    import random
    import re

    draw = random.Random(11)
    parts = ["/", "//", "a", "b.go", "c-d", ":12", ":3:4", " ", "x.py:7", ".", "_", "\n", "go", "é/"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 14))) for _ in range(400)] + ["a.go:12b.go:3"]
    shown = lambda t: re.sub(r"/(?:[A-Za-z0-9._-]*/)*([A-Za-z0-9._-]+)/*", r"\1", t)
    lined = lambda t: re.sub(r"(?:[\w.\-]*/)*([\w.\-]+\.(?:go|py|js|ts|java|rb|rs|php|cs|c|cpp|h)):\d+(?::\d+)?", r"\1:LINE", t, flags=re.ASCII)
    one = lambda masks, by: tuple(m for m in masks if m[1] == by)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", textnorm.masked(F.col("t"), one(textnorm.DISPLAY_MASKS, "$1")).alias("d"), textnorm.masked(F.col("t"), one(textnorm.LINE_MASKS, "$1:LINE")).alias("l")).collect()
    for r in got:
        assert (r.d, r.l) == (shown(texts[r.i]), lined(texts[r.i])), texts[r.i]
    long = ["/ab" * 100_000, "/" * 200_000, "ab/" * 100_000 + "x.go:7", "a." * 100_000]
    out = spark.createDataFrame(list(enumerate(long)), "i int, t string").select("i", F.length(textnorm.mask_message("t")).alias("d"), textnorm.mask_line("t").alias("l")).orderBy("i").collect()
    assert out[0].d == 2 and out[2].l == "x.go:LINE"
