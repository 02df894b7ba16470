import pytest
from pyspark.sql import functions as F

from stationflow.llm.common import table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return table(spark, FOLDER, "documents")


@pytest.fixture(scope="session")
def odd(spark):
    """NULLs, empty and blank texts, repeated rows and ids, a very long text, and extra columns with clashing names."""
    long = "alpha beta gamma delta " * 20_000
    rows = [
        (1, "The same short text", 0.1), (1, "The same short text", 0.1), (1, "another text of that id", 0.2), (None, None, None),
        (None, "text without id", None), (7, None, 1.0), (8, "", 1.0), (9, " \t\n ", 1.0), (10, long, 1.0), (11, "word", 2.0),
        (12, "ÀÉ \U0001f600 straße İSTANBUL ǅ x", 3.0), (13, "The same short text", 4.0),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score double")
    return frame.withColumns({"fp": F.lit("x"), "label": F.lit(3), "n_words": F.lit(0), "e": F.lit(1), "w": F.lit(2), "hash": F.lit(5)})


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0), (8, 0, 1), (10, 1, 1), (11, 0, 0), (None, 1, 1), (12, None, None), (13, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
