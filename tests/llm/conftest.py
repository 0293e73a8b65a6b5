import pytest


@pytest.fixture
def frame(spark):
    """A table of documents from (doc_id, text) pairs, with extra columns whose names clash."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", 0.5, 7, b"x") for i, t in rows], "doc_id long, text string, lang string, source string, score double, n_tokens long, fp binary")

    return make
