import random

import pytest
from pyspark.sql import types as T

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names the operators use themselves.
        T.StructField("n_tokens", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("_key", T.StringType()),
        T.StructField("size", T.StringType()),
    ]
)


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


def awkward() -> list[tuple]:
    """Rows with nulls in every column, empty and long texts, copies, near copies and repeated rows."""
    rng = random.Random(3)
    long = prose(rng, 30_000)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "CHANGED"
    texts = [
        None, "", " \t\n", "one", "One", "ONE", "one two three four", "x" * 5_000, long, base, base.upper(), " ".join(near),
        "a" * 400, base + " " + long[:300], "Ünïcode é 中文 \U0001F600 <|endoftext|> end", "same same same same same same",
        *[prose(rng, rng.randint(1, 60)) for _ in range(20)],
    ]
    rows = [(i, t, ["en", None, "de"][i % 3], ["a", "b", None][i % 3], 7, "x", "y", "z", "w") for i, t in enumerate(texts)]
    rows.append((None, base, None, None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None, None))
    rows += [rows[9], rows[9], (9, "another text of the same id", "en", "a", 1, "", "", "", "")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return awkward()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
