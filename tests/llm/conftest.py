import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def corpus(spark):
    """Awkward documents: nulls, empty and very long texts, ties and repeated rows, and a column that clashes with names used inside the operators."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, "A shared line of text\nown one\n  a SHARED line of text\t\nshort", "x"), (2, "a shared line of text\nother", "x"), (3, None, "x"), (4, "", None), (5, long, "x"), (6, long + " end", "x"),
        (7, "a shared line of text\nother", "x"), (7, "a shared line of text\nother", "x"), (None, "a shared line of text", "x"), (8, "\n\n", "x"), (9, "ünïcödé 😀 line of text\r\nünïcödé 😀 line of text", "x"), (10, "ünïcödé 😀 LINE of text", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, score string").withColumns({"hits": F.lit("clash"), "id": F.lit(0), "key": F.lit("k")})
