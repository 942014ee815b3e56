import pytest


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    long = "alpha beta gamma delta " * 3000
    rows = [
        (1, "one two three four five six seven eight nine ten eleven", "a", 1),
        (1, "one two three four five six seven eight nine ten eleven", "a", 1),
        (2, "", None, None),
        (3, None, "b", 2),
        (None, "a null id", "c", 3),
        (4, long, "d", 4),
        (5, long + "omega", "d", 4),
        (6, "x" * 50_000, "d", 4),
        (7, " \n\t ", "d", 4),
        (8, "été \U0001f600 naïve \u0000 mail me@example.org +1 (212) 555-0100", "d", 4),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, fp long")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, score string, fp long")
