from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(900)]


@pytest.fixture(scope="session")
def odd_rows(words):
    """Null and empty texts, white space, one very long text, repeated rows, a null id, odd characters."""
    long = " ".join(words * 60)
    return [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "two words"), (6, long), (7, " ".join(words[:80])), (7, " ".join(words[:80])),
        (None, " ".join(words[100:190])), (None, None), (8, "é ü   \x1c ź 日本語 🎉 <|endoftext|> \\### x"), (9, "a a a a a a\na a a\na a a"), (2**62, "big id"), (-5, "negative id"),
    ]


@pytest.fixture()
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture()
def clashing(odd):
    """The same rows with columns of names that operators use themselves."""
    from pyspark.sql import functions as F

    names = ["kept", "score", "n_words", "class_id", "n_links", "start", "length", "ids", "fp", "node", "u", "v", "held_out", "bucket", "path", "license", "lang", "rid", "_key", "_hash", "text_hash", "component", "symbols", "words", "h", "n"]
    return odd.select(*(F.lit(f"x{i}").alias(n) for i, n in enumerate(names)), "text", "doc_id")


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
