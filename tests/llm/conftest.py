import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, lang[, source]]) tuples."""
    def build(rows):
        full = [(*r, *(None,) * (4 - len(r))) for r in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string")
    return build
