import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents from texts, or from (doc_id, text) pairs."""

    def make(texts, source="s"):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", source, None if t is None else len(t)) for i, t in pairs], SCHEMA)

    return make


@pytest.fixture(scope="session")
def real(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
