import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __id string, key string, row string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Makes documents of texts, or of (doc_id, text) pairs, with extra columns of names that operators use themselves."""

    def make(texts, langs=None, sources=None):
        pairs = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
        rows = [(i, t, (langs or ["en"] * len(pairs))[k], (sources or ["s"] * len(pairs))[k], None if t is None else len(t), "x", "y", "z") for k, (i, t) in enumerate(pairs)]
        return spark.createDataFrame(rows, DOCS)

    return make
