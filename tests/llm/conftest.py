import pytest

DOCS = "doc_id bigint, text string, n bigint, node string, score double, `group` int"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows to documents with columns whose names operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, 1, "x", 0.5, 2) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and blank texts, repeated rows, equal texts, a long text, letters beyond the basic plane."""
    return [(1, "Alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (4, " \t\n "), (5, "Alpha beta gamma delta epsilon zeta"), (1, "Alpha beta gamma delta epsilon zeta"), (None, "no id here"), (6, "word " * 20_000), (7, "naïve 😀 ΑΣ İ <|endoftext|> it's 12.5%"), (8, "x" * 5_000)]
