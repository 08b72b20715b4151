import pytest


@pytest.fixture
def documents(spark):
    """Makes a table (doc_id, text, and columns whose names the operators use themselves)."""

    def make(rows):
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        return df.selectExpr("doc_id", "text", "'a' AS position", "2 AS row", "'k' AS key", "array(1) AS token_ids", "'s' AS sketch", "0 AS n_words")

    return make
