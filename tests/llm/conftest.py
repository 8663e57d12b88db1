from __future__ import annotations

import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = ["ka", "lo", "mi", "ter", "an", "sho", "ri", "ve", "nu", "pel", "da", "go"]


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, ties, repeated rows, a very long text."""
    rng = random.Random(3)
    body = " ".join(words(rng, 60))
    long_text = " ".join(words(rng, 30_000))
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, " \n\t ", None, "a", 4), (3, "one", "en", None, 3), (4, body, "en", "b", 1),
            (5, body, "en", "b", 1), (5, body, "en", "b", 1), (6, body.upper(), "fr", "b", None), (None, body, None, None, None),
            (7, long_text, "en", "b", len(long_text)), (8, "12 34 !!", "de", "c", 8), (9, "été naïve 漢字 😀", "fr", "c", 15)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOC)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """The same rows with extra columns that bear names the operators use inside."""
    from pyspark.sql import functions as F

    names = ["_c", "_id", "_k", "_text", "_gone", "_gone_c", "_dirty", "_said", "_sh", "_u", "_w", "size", "score", "predicted", "lang_pred",
             "class_id", "taken", "label", "token", "bucket", "_bucket", "n", "count"]
    return odd_docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
