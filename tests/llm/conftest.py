import pytest
from pyspark.sql import types as T


@pytest.fixture
def frame(spark):
    """frame(schema, *rows): also with no rows."""
    return lambda schema, *rows: spark.createDataFrame(list(rows), schema)


@pytest.fixture
def wide(frame):
    """Documents with clashing extra columns."""
    return lambda *rows: frame("doc_id long, text string, h1 string, n long, key string, w string, fp int, kept_text string", *[(i, t, "x", 1, "k", "w", 3, "old") for i, t in rows])


__all__ = ["T"]
