import pytest


@pytest.fixture
def frame(spark):
    """documents of the given (id, text) rows, with extra columns whose names clash with the operators' own."""

    def make(rows):
        rows = [(i, t, "x", 1, "y", 0, 2) for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, kept string, n long, id string, salt int, digest int")

    return make
