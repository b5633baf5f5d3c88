import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Makes documents of texts; each may be a text or (doc_id, text, lang, source)."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r, "en", "s") for i, r in enumerate(rows)]
        return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], COLUMNS)

    return make
