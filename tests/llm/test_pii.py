import hashlib
import os
import re
import subprocess
import sys
from datetime import date
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from opsloom.llm import pii
from pyspark.sql import functions as F


def luhn(text):
    d = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d[0::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])


def made(spark, texts, secret="secret"):
    rows = pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), secret, found="kinds").orderBy("doc_id").collect()
    return [r.text for r in rows], [r.kinds for r in rows]


def test_formats_and_links(spark):
    values = {
        "card": ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "378282246310005"],
        "ip": ["10.0.200.3", "255.255.255.255", "0.0.0.0"], "ssn": ["123-45-6789", "899-99-9999", "001-01-0001", "667-01-0001"],
        "phone": ["+1 (017) 555-7713", "(212) 555-0100", "212-555-0100", "+44 20 7946 0958"],
        "day": ["2024-02-29", "29.02.2024", "29/02/2024", "02/29/2024", "2024/02/29", "1800-01-01", "2199-12-31"],
        "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"], "email": ["a.b+c@mail.example.com", "été.55@mail4.example.com"],
    }
    flat_ = [(k, v) for k, vs in values.items() for v in vs]
    new, kinds = made(spark, [f"({v})x" if k == "phone" and v[0] != "(" else f"see {v}, and {v}." for k, v in flat_])
    for (kind, old), text, found in zip(flat_, new, kinds, strict=True):
        assert old not in text and set(found) == {kind}, (old, text, found)
        out = re.match(r"see (.*), and (.*)\.$", text)
        value = out[1] if out else text[1:-2]
        assert not out or out[1] == out[2]
        if kind != "email":
            assert re.sub("[0-9]", "9", value) == re.sub("[0-9]", "9", old) or kind == "ip"
        if kind == "card":
            assert luhn(value) % 10 == 0
        if kind == "ip":
            assert all(0 <= int(x) <= 255 for x in value.split("."))
        if kind == "ssn":
            a, g, n = map(int, value.split("-"))
            assert 0 < a < 900 and a != 666 and g and n
        if kind == "day":
            parts = [int(x) for x in re.split("[-/.]", value)]
            y, m, d = parts if parts[0] > 31 else (parts[2], parts[0], parts[1]) if old == "02/29/2024" else parts[::-1]
            assert date(y, m, d) and 1800 <= y <= 2199
        if kind == "iban":
            t = value.replace(" ", "")
            assert int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1
    digits = lambda i: re.sub(r"\D", "", new[i])
    assert digits(0) == digits(1) == digits(2)  # one card in three notations


def test_other_numbers_stay(spark):
    plain = [None, "", "4111 1111 1111 1112", "256.1.1.1", "000-12-3456", "2023-02-29", "31.04.2024", "version 1.2.3", "12345", "DE88 3704 0044 0532 0130 00", "a@b", "9575180", "1.2.3.4.5", "3.14159", "0000000000000000"]
    new, kinds = made(spark, plain)
    assert new == plain and not any(kinds)


def test_valid_values_inside_other_numbers_go(spark):
    card, iban, spaced = "4111 1111 1111 1111", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    cases = [
        (f"card {card} 12/25", card, "card"), (f"card {card} 123", card, "card"), (f"order 7 {card}, paid", card, "card"), (f"12345 {card} 1", card, "card"), (f"NR12 {card}", card, "card"),
        ("x 4111-1111-1111-1111-99 x", "4111-1111-1111-1111", "card"), (f"{iban} EUR", iban, "iban"), (f"{spaced} BIC", spaced, "iban"), (f"{spaced} COBADEFFXXX 55", spaced, "iban"), (f"AB12 {spaced} X", spaced, "iban"),
        ("4 123-45-6789 12345", "123-45-6789", "ssn"), ("7 212-555-0100 123", "212-555-0100", "phone"), ("1 2024-02-29 12300 1", "2024-02-29", "day"), ("+44 20 7946 0958 1234 55", "+44 20 7946 0958", "phone"), ("+1.23.45.67", "1.23.45.67", "ip"),
    ]
    new, kinds = made(spark, [t for t, _, _ in cases])
    for (old, value, kind), text, found in zip(cases, new, kinds, strict=True):
        assert value not in text and kind in found, (old, text, found)
    alone, _ = made(spark, [card, iban, spaced])
    assert new[:2] == [f"card {alone[0]} 12/25", f"card {alone[0]} 123"] and new[6:8] == [f"{alone[1]} EUR", f"{alone[2]} BIC"]
    both, kinds = made(spark, [f"a@b.example 256.1.1.1 {card} 12/25 and {iban} EUR 10.0.0.1 4111 1111 1111 1112"])
    assert kinds == [["email", "card", "iban", "ip"]] and "256.1.1.1 " in both[0] and both[0].endswith("4111 1111 1111 1112")


def test_permutation_is_keyed_and_one_to_one(spark):
    ips = [f"10.0.{i // 256}.{i % 256}" for i in range(2000)]
    a, _ = made(spark, ips)
    b, _ = made(spark, ips, secret="other")
    assert len(set(a)) == len(ips) and sum(x == y for x, y in zip(a, b, strict=True)) == 0
    days = spark.range(146097).select(F.col("id").alias("doc_id"), F.date_add(F.to_date(F.lit("1800-01-01")), F.col("id").cast("int")).cast("string").alias("text"))
    assert pii.pseudonymised(days, "secret").select("text").distinct().count() == 146097


def test_edges(clashing, nothing):
    out = pii.pseudonymised(clashing, "secret")
    assert out.columns == clashing.columns and sorted(map(str, out.collect())) == sorted(map(str, clashing.collect()))
    assert pii.pseudonymised(nothing, "secret").count() == 0


def test_native_plan(spark):
    plan = pii.pseudonymised(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "secret")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def feistel(secret, kind, left, right, a, b, tweak=""):
    key = "pii-" + hashlib.sha256(secret.encode()).hexdigest()
    draw = lambda i, x: int(hashlib.sha256(f"{key}|{kind}|{tweak}|{i}|{x}".encode()).hexdigest()[:15], 16)
    for i in range(1, 9):
        if i % 2:
            left = (left + draw(i, right)) % a
        else:
            right = (right + draw(i, left)) % b
    return left, right


def digits_by_hand(secret, kind, text):
    k = (len(text) + 1) // 2
    left, right = feistel(secret, kind, int(text[:k]), int(text[k:]), 10**k, 10 ** (len(text) - k), len(text))
    return f"{left:0{k}}{right:0{len(text) - k}}"


def test_values_against_a_network_by_hand(spark):
    def card(t):
        body = digits_by_hand("k", "card", t[:-1])
        return body + str(next(c for c in range(10) if luhn(body + str(c)) % 10 == 0))

    def ip(t):
        o = [int(x) for x in t.split(".")]
        left, right = feistel("k", "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"

    def iban(t):
        inner = iter(digits_by_hand("k", "iban", "".join(c for c in t[4:] if c.isdigit())))
        body = "".join(next(inner) if c.isdigit() else c for c in t[4:])
        number = "".join(str(int(c, 36)) for c in body + t[:2] + "00")
        return t[:2] + f"{98 - int(number) % 97:02}" + body

    def day(t):
        n = (date.fromisoformat(t) - date(1800, 1, 1)).days
        left, right = feistel("k", "day", n // 773, n % 773, 189, 773)
        return date.fromordinal(date(1800, 1, 1).toordinal() + left * 773 + right).isoformat()

    phone = lambda t: digits_by_hand("k", "phone", t)
    cases = [(card, "4111111111111111"), (card, "378282246310005"), (ip, "10.0.200.3"), (ip, "0.0.0.0"), (iban, "DE89370400440532013000"), (iban, "GB82WEST12345698765432"), (day, "2024-02-29"), (day, "1800-01-01"), (day, "2199-12-31")]
    new, _ = made(spark, [t for _, t in cases] + ["+442079460958"], "k")
    assert new == [f(t) for f, t in cases] + ["+" + phone("442079460958")]


def test_very_long_texts(spark):
    labels, numbers, at = "a@" + "b." * 100_000 + "example", "4111 " * 50_000, "@" * 200_000
    new, kinds = made(spark, [labels, at, "x@a..b.example", numbers[:3000]])
    assert kinds[0] == ["email"] and len(new[0]) < 100 and new[1] == at and new[2] == "x@a..b.example"


def test_columns_named_as_its_own(spark):
    rows = spark.createDataFrame([(1, "10.0.0.1", "x", "y", "z")], "doc_id long, text string, _pii_gaps string, _PII_matches string, _pii_made string")
    out = pii.pseudonymised(rows, "secret")
    assert out.columns == rows.columns and out.first()[2:] == ("x", "y", "z")


def test_the_secret_is_not_shown(spark):
    out = pii.pseudonymised(spark.createDataFrame([(1, "10.0.0.1")], "doc_id long, text string"), "hunter2hunter2")
    shown = spark.sparkContext._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "extended")
    assert "hunter2" not in shown and not re.search("pii-[0-9a-f]{64}", shown)


SMALL_HEAP = """
import sys

from opsloom.llm import pii
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
out = pii.pseudonymised(spark.read.parquet(sys.argv[1]), "secret", found="kinds")
print("got", *out.agg(F.count("*"), F.min(F.length("text")), F.sum(F.size("kinds"))).first())
"""


def test_long_texts_need_no_large_heap(tmp_path):
    """1,500 texts of 120,000 characters in one row group; a reader that keeps them all needs an array of 180 MB or more and one to copy into it."""
    pq.write_table(pa.table({"doc_id": list(range(1500)), "text": ["word " * 24_000] * 1499 + ["word " * 24_000 + "10.0.0.1"]}), tmp_path / "docs.parquet", use_dictionary=False, compression="zstd")
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--driver-memory 520m pyspark-shell", "PYTHONPATH": str(Path(__file__).resolve().parents[2])}
    done = subprocess.run([sys.executable, "-c", SMALL_HEAP, str(tmp_path / "docs.parquet")], env=env, capture_output=True, text=True, timeout=300)
    assert "got 1500 120000 1" in done.stdout, re.findall(".*OutOfMemory.*", done.stderr)[:1] or done.stderr[-2000:]
