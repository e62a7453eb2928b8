import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A table of (doc_id, text[, lang[, source]]) rows, written once so that it is read like any other."""

    def make(rows, tmp=None, schema=SCHEMA):
        full = [tuple(r) + (None,) * (5 - len(r)) for r in rows]
        return spark.createDataFrame(full, schema)

    return make


#: Rows that every operator must take: nulls in any column, empty, blank and very long texts, ties and repeated rows.
AWKWARD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \n\t ", "en", "a"),
    (4, "word " * 60_000, "en", "a"),
    (5, "plain text of a few words here", "en", None),
    (5, "plain text of a few words here", "en", None),
    (6, "é 中 😀 \x00 ▁ İ K", None, "b"),
    (None, "a row without an id but with some words in it", "en", "b"),
    (7, "plain text of a few words here", "en", "c"),
]


@pytest.fixture
def awkward(docs):
    return docs(AWKWARD)


@pytest.fixture
def empty(docs):
    return docs([])
