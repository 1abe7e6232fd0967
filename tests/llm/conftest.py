import pytest


@pytest.fixture
def docs(spark):
    """A frame of documents from (doc_id, text) pairs, with columns whose names clash with names used inside."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t), "x", 7) for i, t in rows],
                                     "doc_id long, text string, lang string, source string, n_chars long, component string, "
                                     "sig int")
    return make
