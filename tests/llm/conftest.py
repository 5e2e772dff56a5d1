import random

import pytest

LONG, NULL = "bigint", None
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, key string, row int, kept string, n_words int, bucket int"


def prose(rng, n, vocabulary=800):
    return " ".join(f"w{rng.randrange(vocabulary)}x" + (".\n" if k % 9 == 8 else "") for k in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, near copies, and extra columns whose names clash."""
    rng = random.Random(5)
    base = prose(rng, 200)
    near = base.split(" ")
    near[50] = "changed"
    texts = [
        (1, base), (2, base), (3, " ".join(near)), (4, ""), (5, None), (6, "one two"), (7, "one two"), (8, "ONE two"), (None, base), (None, "lonely words here"),
        (9, prose(rng, 40_000)), (9, "same id other text, twice"), (9, "same id other text, twice"), (10, "\u00e9\u00e8 \U0001f600 \u4f60\u597d " * 40),
        (11, "aaaa" * 300), (12, " \n\t \n"), (13, prose(rng, 120) + " " + base), (9007199254740993, "a b c d e f g h i j k l m n"),
        (14, base.lower().replace("w", "W")), (15, "x" * 50_000), (16, "tail <|endoftext|> of  two   spaces\n\n\nand\x1cmore\u2003"),
    ]
    return [(i, t, "en" if k % 3 else None, f"s{k % 5}" if k % 7 else None, len(t or ""), "x", "y", 1, "z", 2, 3) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
