import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, rank int, d string, size long"


@pytest.fixture
def docs(spark):
    """Makes documents with clashing extra columns from (doc_id, text) pairs."""

    def make(pairs):
        rows = [(i, t, None, "s", None if t is None else len(t), "x", 3, "y", -1) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS).repartition(3) if rows else spark.createDataFrame([], DOCS)

    return make
