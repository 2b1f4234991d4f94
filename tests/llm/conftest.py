import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text, ...) rows; what is missing is null."""
    def make(rows, more=""):
        width = DOCS.count(",") + 1
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], DOCS)
    return make
