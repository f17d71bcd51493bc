import random

import pytest
from pyspark.sql import functions as F

#: Names that operators use inside; extra columns of these names must do no harm.
CLASHES = ["row", "occ", "key", "size", "kept", "level", "identity", "range", "bucket", "chunk", "payload", "task", "rank",
           "length", "n", "u", "v", "comp", "label", "own", "new", "next", "guest", "score", "_text", "spans", "rep", "root", "name", "i"]

SYLLABLES = ["the", "an", "ing", "er", "on", "sh", "ha", "tion", "re", "th", "ou", "nd", "wh", "ly", "ed"]


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    for k in range(6, n, 9):
        words[k] += "."
    return " ".join(words)


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text): nulls, empty and very long texts, ties, repeated rows."""
    rng = random.Random(4)
    plain = [(i, prose(rng, rng.randint(3, 120))) for i in range(60)]
    return [
        *plain, (100, None), (101, ""), (102, " \t\n"), (103, plain[0][1]), (104, plain[0][1].replace(" ", "  ", 3)), (105, plain[1][1] + " more"),
        plain[2], plain[2], (None, plain[3][1]), (None, None), (106, prose(rng, 9000)), (107, "x" * 30_000), (108, "a. " * 4000), (109, "ünï cödé 文字 😀. " * 20),
        (110, "\n".join(["same line"] * 50)), (2, "another text under the same id"),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    df = spark.createDataFrame(edge_rows, "doc_id long, text string").repartition(3)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(40)] + [(3, None), (None, 1)], "doc_id long, toxic int")
