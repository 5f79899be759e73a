import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from (doc_id, text[, lang[, source]])."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def tiny(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


ODD = [
    (1, None, None, None), (2, "", "en", "s"), (3, "a", "en", None), (4, " \t\n ", "de", "s"), (5, "word " * 30_000, "en", "s"),
    (6, "the same text again and again here", "en", "s"), (6, "the same text again and again here", "en", "s"), (None, "no id at all in this row", "fr", "t"),
    (7, "ß é \U0001f600   x", "de", "s"), (8, "x" * 200_000, "en", "s"),
]


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(ODD)


@pytest.fixture(scope="session")
def odd_rows():
    return ODD
