import pytest

ROWS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of (id, text) pairs in several partitions."""

    def make(pairs, **columns):
        rows = [(i, t, columns.get("lang", "en"), "s", len(t or "")) for i, t in pairs]
        return spark.createDataFrame(rows, ROWS).repartition(3)

    return make
