import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


#: Rows with nulls, empty and long texts, repeats, and columns whose names clash with results.
@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(1, None, None, "x"), (2, "", "en", "y"), (2, "", "en", "y"), (None, "some words here to read", "en", None), (3, "é" * 70_000, "fr", "z"), (4, "a" * 70_000, "en", "z"), (5, "1234 5678", None, "z"), (6, "some words here to read", "en", "q"), (7, "  \n\t ", "en", "q")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
