import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with all columns, and one more, from (doc_id, text) or (doc_id, text, lang) rows."""

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "src", None, "extra") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, component_id string")

    return make
