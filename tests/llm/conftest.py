import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_rows() -> list[tuple]:
    """Nulls in any column, empty and long texts, ties, repeated rows, odd bytes."""
    draw = random.Random(5)
    vocabulary = ["alpha", "beta", "gamma", "delta", "épée", "the", "of", "x1", "ZETA", "#tag", "日本", "end."]
    prose = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    base = prose(80)
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, None), (None, base, "en", "b", 1), (5, base, None, "b", 1), (5, base, None, "b", 1),
        (6, base.replace("gamma", "gamma gamma", 1), "en", "b", 1), (7, prose(4000), "en", "c", 1), (8, "one", "en", "c", 1), (9, "\n".join(["same line here"] * 30), "en", None, 1),
        (10, "no\x00break\x0b\x0cspace wide " * 20, "en", "é", 1), (11, "a\r\nb\r\na\r\n\n\nb", "en", "Z", 1), (12, "🙂 " * 60, "en", "z", 1), (13, "日本語のテキスト。" * 40, "ja", "z", 1),
    ]
    return rows + [(100 + i, prose(draw.randint(1, 150)), "en", draw.choice("abc"), 1) for i in range(120)]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCUMENTS)


@pytest.fixture(scope="session")
def clashing(awkward):
    """The same rows with extra columns named as the operators name theirs."""
    from pyspark.sql import functions as F

    return awkward.select("*", *(F.lit(i).alias(c) for i, c in enumerate(["d", "t", "p", "size", "block", "kept", "score", "n_words", "_k", "key", "pos", "start", "end"])))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


def thue_morse(a, b, n):
    """The sequence of n items over a and b that has no square of squares, and its complement: polynomial hashes modulo 2**64 can't tell them apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return [(a, b)[x] for x in bits], [(b, a)[x] for x in bits]
