import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, labels string, sequence_id string, slot int, kept string, feature string"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", None if text is None else len(text), 0.5, "x", "y", 1, "z", "f")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows and ids, columns that clash with results."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    rows = [row(1, None), row(2, ""), row(3, "   \n\t "), row(4, long), row(None, "The MIT License applies"), row(5, "short"), row(5, "short"), row(6, long), row(None, None, None), row(7, "é世界 <|endoftext|> İ ǅ 0️⃣"), row(8, "a" * 9000), row(9, "?!"), row(5, "another text of this id")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
