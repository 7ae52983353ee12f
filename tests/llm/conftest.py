import random

import pytest
from pyspark.sql import types as T

CLASHING = ["id", "body", "fp", "component_id", "slot", "bucket", "kept", "n", "weight", "tokens", "probability", "uid", "block", "length", "score", "chunk", "shard", "_in_0"]

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in CLASHING]
)


def documents(spark, rows):
    """A table of documents with extra columns named like those the operators use inside."""
    full = [(*r, *([None, None] if len(r) == 2 else [])) for r in rows]
    return spark.createDataFrame([(*r, *[f"x{i}" for i in range(len(CLASHING))]) for r in full], SCHEMA)


def prose(rng, n, words=("the", "of", "and", "a", "reed", "stone", "water", "light", "ring", "house", "tree", "cloud", "river", "glass")):
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "ing", "ed"]) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and blank texts, a very long one, ties, repeated rows, a null id."""
    rng = random.Random(3)
    long = prose(rng, 40_000)
    same = prose(rng, 90)
    rows = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \t\n ", None, None),
        (4, long, "en", "b"),
        (5, same, "en", "a"),
        (6, same, "fr", "b"),
        (6, same, "fr", "b"),
        (7, same + " one more word", "fr", "a"),
        (8, "x", "en", "a"),
        (9, "Straße ÉTÉ été 北京 " * 30, "de", "c"),
        (None, "a text of no id", "en", "a"),
        (10, "a" * 1500, "en", "a"),
    ]
    return documents(spark, rows).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return documents(spark, [])
