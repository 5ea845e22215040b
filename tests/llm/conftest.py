import random

import pytest

LONG = "alpha beta gamma delta " * 20_000


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    rng = random.Random(3)
    words = "the of and to ing tion ble ness park river stone light".split()
    out = [
        (1, "", "a"), (2, None, "a"), (3, " \t\n", None), (4, LONG, "b"), (5, "same text here", "b"), (6, "same  text\nhere", "b"),
        (7, "sametexthere", "b"), (8, "same text here", None), (8, "same text here", None), (None, "no id at all", "c"), (9, "été Été a b", "c"),
    ]
    for i in range(10, 60):
        n = rng.choice([3, 40, 80, 200])
        out.append((i, "\n".join(" ".join(rng.choice(words) for _ in range(n // 4)) for _ in range(4)), rng.choice("abc")))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with further columns whose names clash with the operators' own."""
    return spark.createDataFrame(
        [(i, t, s, "x", -1, i, 7) for i, t, s in rows], "doc_id bigint, text string, source string, key string, size int, row bigint, n int"
    ).repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
