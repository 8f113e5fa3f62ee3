import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """Builds documents from (doc_id, text) or (doc_id, text, source)."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def table():
    """Real rows of the smallest driver table, if it is there."""
    import os

    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    return path


@pytest.fixture(scope="session")
def middle():
    import os

    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    return path


def odd_rows():
    """Nulls, empty and very long texts, white space alone, repeated rows."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    return [(None, None), (None, "a b c d e f"), (1, None), (2, ""), (3, " \t\n\r"), (4, long), (5, "one"), (6, "one two three four five six"), (6, "one two three four five six"), (7, "Éa ß 語 x\n\nEa"), (8, "one two three four five six")]


@pytest.fixture
def odd(docs):
    return docs([(*r, None if i % 3 == 0 else f"s{i % 2}") for i, r in enumerate(odd_rows())])
