import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text, lang, source) as a table of documents with a column whose name clashes."""

    def make(rows):
        full = [(*r, *(None,) * (4 - len(r)), "x") for r in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, fingerprint string")

    return make
