import pytest

WORDS = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="session")
def table(spark):
    """A documents table, with a column whose name clashes with one the operators use."""

    def make(rows, parts=3):
        frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, n long")
        return frame.repartition(parts) if rows else frame

    return make
