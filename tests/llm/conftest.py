import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for their own columns.
CLASH = {"digest": "'a'", "rank": "1", "size": "2", "taken": "3", "fp": "4", "component": "5", "terms": "'b'",
         "of": "6", "key": "7", "tie": "8", "term": "'c'", "label": "9", "held_out": "10", "row_id": "11",
         "best": "12", "doc": "13", "text_hash": "14"}


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "The", "of", "and", "über", "niño", "x1"])
                    for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, a hot source and a hot text."""
    rng = random.Random(5)
    rows = [(1, None, None, None, None), (2, "", "en", "s1", 0), (3, " \t\n", "en", "s1", 3),
            (None, "no id here", "en", "s2", 10), (4, "Same Text", "en", "s1", 9), (5, "same text", "de", "s2", 9),
            (5, "same text", "de", "s2", 9), (6, "same text é", "de", None, 11), (7, "SAME TEXT É", "fr", "s3", 11),
            (8, words(rng, 60_000), "en", "s1", 0), (9, "z" * 30_000, "en", "s3", 0), (10, "日本語 текст", "xx", "s3", 0),
            (11, "one", "en", "s4", 3), (12, "two words", "en", "s4", 9)]
    rows += [(100 + i, "hot text here now", "en", "hot", 17) for i in range(60)]
    rows += [(200 + i, words(rng, rng.randint(1, 40)), rng.choice(["en", "de"]), "hot", 0) for i in range(60)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def clashing(odd):
    return odd.selectExpr("*", *[f"{v} AS {k}" for k, v in CLASH.items()])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
