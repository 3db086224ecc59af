import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, lang, source); an extra column may be asked for."""

    def make(rows, extra=None):
        rows = [(*(tuple(r) + (None,) * (4 - len(r))), None) for r in rows]
        df = spark.createDataFrame(rows, DOCS)
        return df.selectExpr("*", extra) if extra else df

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls in every column, empty and long texts, ties, repeated rows, a clashing extra column."""
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, "one two three four five six", "en", "a"), (4, "one two three four five six", "fr", "b"),
        (4, "one two three four five six", "fr", "b"), (5, "  \t\n ", "en", "a"), (6, "word " * 30_000, "en", "b"), (7, "a b 中文 тест", None, "c"),
        (None, "no id here at all friend", "de", None), (8, "x", "en", "a"),
    ]
    return make_docs(rows, "doc_id as size")


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
