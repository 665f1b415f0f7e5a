import pytest

EDGE = [
    (1, "plain words of a text", "x"), (2, None, "y"), (3, "", "z"), (4, "  \n\t ", None), (4, "  \n\t ", None),
    (5, "word " * 30_000, "long"), (6, "x" * 120_000, "unbroken"), (7, "Ünïcödé 日本 text \x1c here", "u"),
    (None, "no key at all", "n"), (8, "plain words of a text", "copy"),
    (9, "one of two unlike texts under a key", "p"), (9, "what else is filed there has no word in common", "q"),
]
SCHEMA = "doc_id bigint, text string, score string"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty, blank, long, repeated and equal texts, and a column named as an output."""
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
