import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, k1 long, bin string, id string"


@pytest.fixture(scope="session")
def docs(spark):
    """Rows of (doc_id, text[, source]) as documents with extra columns of clashing names."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, 2, "x", "y") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(docs):
    """Nulls, empty and blank texts, a very long text, repeated rows, ties, odd characters."""
    long = " ".join(f"w{k % 977} x{k % 13}." for k in range(30_000))
    return docs([
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, long), (6, "a b c d e f"), (6, "a b c d e f"), (7, "a b c d e f", None),
        (None, "a b c d e f"), (None, None), (8, "日本語 テキスト é\x00 👩‍👩‍👧\r\nx y"), (9, "x" * 40_000),
    ])


@pytest.fixture(scope="session")
def none(docs):
    return docs([(1, "x")]).where("false")
