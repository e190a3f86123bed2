import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use themselves, to be ignored when a table brings its own.
CLASH = ("score", "fp", "d", "t", "i", "bucket", "found", "fingerprint", "component_id", "piece", "end", "h", "y", "slot", "gone", "lines", "digest", "refers_to", "held_out")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(4)
    long = "\n".join(words(rng, 60) for _ in range(400))
    body = words(rng, 80)
    texts = [(1, body), (2, body), (3, body + " one more"), (4, ""), (5, None), (6, long), (6, long), (7, long + "\n" + body), (8, "\n\n\n"), (9, "Ünïcödé ß 漢字 \U0001f600 end"), (None, words(rng, 70)), (None, None), (10, "x" * 50_000), (11, " ")]
    return [(i, t, None if k % 3 else "en", None if k % 4 else "src0", None if t is None else len(t)) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    from pyspark.sql import functions as F

    return odd.withColumns({c: F.lit("clash") for c in CLASH})
