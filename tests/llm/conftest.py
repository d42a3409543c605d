import random

import pytest

#: A clashing schema: the columns of documents, and extra ones named like the operators' own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, comp long, bucket int, id long, target double, _row string"
#: Names of the operators' helpers.
HELPERS = ("_keep", "keep", "nth", "_nth", "_m", "_new", "_kinds", "_slot", "_turn", "_size", "_key", "_drawn", "_bad", "there", "v", "weight", "score", "c0", "_q", "_fence")


def rows(texts):
    return [(i, t, "en", f"s{(i or 0) % 2}", len(t or ""), 1, True, 2, 3, 4, 5.0, "x") for i, t in texts]


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and blank texts, repeated rows, ties, a long text, extra columns with clashing names."""
    rng = random.Random(5)
    long = ". ".join(words(rng, 12) for _ in range(900)) + "."
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, long), (6, long), (7, "a b c d e f g. " * 30), (7, "a b c d e f g. " * 30), (None, long), (None, None), (9, "é" * 80), (10, "é" * 80 + "x")]
    data = rows(texts) + [(11, "alone " * 60, None, None, None, None, None, None, None, None, None, None)]
    from pyspark.sql import functions as F

    return spark.createDataFrame(data, SCHEMA).withColumns({h: F.lit(True) for h in HELPERS})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
