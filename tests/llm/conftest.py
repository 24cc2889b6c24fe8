"""Documents with nulls, empty, very long and repeated texts, and columns of clashing names."""

import pytest

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again.\nSecond line of the text here.", "a"),
    (2, None, "a"),
    (3, "", None),
    (4, "   \n\t ", "a"),
    (5, LONG, "b"),
    (5, LONG, "b"),
    (6, "The quick brown fox jumps over the lazy dog again and again.\nAnother second line in this one.", "a"),
    (None, "A text without an id, which is odd but may be found.", "a"),
    (7, "x", "a"),
    (8, "naïve café — 東京 \U0001f600 done", "a"),
    (9, "a" * 5000, "a"),
]
SCHEMA = "doc_id long, text string, score string"


@pytest.fixture(scope="session")
def odd(spark):
    """doc_id, text, and columns whose names operators use themselves."""
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return df.selectExpr("doc_id", "text", "score", "score AS ids", "1 AS key", "'x' AS h", "2 AS n", "'y' AS line", "3 AS sid")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
