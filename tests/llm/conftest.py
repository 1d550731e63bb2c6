import random

import pytest

WORDS = "river stone light winter market paper bridge garden silver window coffee letter mountain harbor forest engine signal copper velvet lantern".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + (rng.choice(WORDS)[:3] if rng.random() < 0.5 else "") for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text, extra column): nulls, empty and blank texts, a long text, ties, repeated rows."""
    rng = random.Random(7)
    base = prose(rng, 120)
    return [
        (1, base, "a"), (2, base, "b"), (2, base, "b"), (None, base, None), (None, None, "c"), (3, None, "d"), (4, "", "e"), (5, "  \n ", "f"),
        (6, prose(rng, 6000), "g"), (7, "é\U0001f600ß", "h"), (8, prose(rng, 90), "i"), (9, "x" * 3000, "j"),
    ]


SCHEMA = "doc_id long, text string, score string"


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
