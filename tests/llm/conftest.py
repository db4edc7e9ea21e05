import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A documents table of (doc_id, text) pairs."""

    def make(rows, extra=()):
        frame = spark.createDataFrame([(i, t, "en", "hot", None if t is None else len(t)) for i, t in rows], DOCS)
        for name in extra:
            frame = frame.selectExpr("*", f"'x' as `{name}`")
        return frame.repartition(3)

    return make
