import pytest

WORDS = [f"w{i}" for i in range(4000)]


def prose(start: int, count: int) -> str:
    """Different words in an order that does not repeat."""
    return " ".join(f"{WORDS[(start * 131 + i * i + 7 * i) % 4000]}x{start}" for i in range(count))


# repeated rows, nulls in any column, empty, blank and very long texts, ties
ROWS = [
    (1, prose(1, 80), "en", "a", 1),
    (2, prose(2, 80), "en", "a", 2),
    (3, None, None, "b", None),
    (4, "", "en", None, 0),
    (5, " \n\t ", "de", "b", 4),
    (6, prose(6, 20_000), "en", "a", 6),
    (7, prose(1, 80), "en", "c", 7),
    (8, prose(8, 60), "en", "c", 8),
    (8, prose(8, 60), "en", "c", 8),
    (None, prose(9, 30), "en", None, 9),
]
NAMES = ["score", "evidence", "size", "taken", "target", "fingerprint", "component_id", "node", "w0", "ids", "pack",
         "answers", "shard", "slot", "n_tokens", "_key", "covered"]


@pytest.fixture(scope="session")
def rows():
    return ROWS


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string, n_chars int")


@pytest.fixture(scope="session")
def wide(docs):
    """The same with further columns that are named like those operators add."""
    from pyspark.sql import functions as F

    return docs.withColumns({name: F.lit(f"old {name}") for name in NAMES})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
