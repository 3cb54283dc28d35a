import pytest


@pytest.fixture(scope="session")
def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark, docs_schema):
    """Documents from (doc_id, text) or (doc_id, text, lang)."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, docs_schema)

    return make
