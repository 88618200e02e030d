import random

import pytest
from pyspark.sql import types as T

WORDS = ["gnu", "General", "été", "mit", "license", "the", "a", "straße", "42", "x"]


def passages(rng, n, low, high):
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high))) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Copies, shared passages, nulls, empty and one-word texts, repeated rows, clashing column names."""
    rng = random.Random(5)
    shared = passages(rng, 4, 8, 30)
    rows = []
    for k in range(60):
        parts = passages(rng, 2, 0, 12)
        parts.insert(1, rng.choice(shared))
        rows.append((k * 3 % 61, " \n".join(parts), "en", 1, "r"))
    rows += [(100, rows[3][1], None, 2, None), (101, rows[3][1], "en", 2, "x"), (102, None, None, None, None),
             (103, "", "fr", 0, ""), (104, "word", "de", 4, "y"), (105, "12 !! 7", "en", 1, "z"),
             (None, shared[0] + " tail", "en", 5, "n"), (None, shared[0] + " tail", "en", 5, "n"),
             (106, "same row twice " + shared[1], "en", 6, "d"), (106, "same row twice " + shared[1], "en", 6, "d"),
             (-7, "first of all " + shared[2], "en", 6, "d"), (107, shared[0] * 40, "en", 1, "long"),
             (108, "é" * 300 + " " + "é" * 300, "fr", 1, "bytes")]
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("_block", T.LongType()), T.StructField("keys", T.StringType())])
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
