import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and very long texts, repeated rows and clashing extra columns."""
    rows = [
        (3, "One two three.\nFour five six seven eight nine ten.", "en", "a", 1),
        (3, "One two three.\nFour five six seven eight nine ten.", "en", "a", 1),
        (None, "null key text with some words", "en", None, None),
        (1, None, None, None, None),
        (2, "", "en", "b", 0),
        (7, "  \n\n \t ", "en", "b", 0),
        (5, "word " * 30_000, "en", "c", 5),
        (6, "Üñï çödé €uro 日本語 text\x1cwith\x1dodd   spaces's don't", "xx", "c", 5),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(1) for c in ("n", "k", "t", "id", "pos", "u", "row", "hash", "words", "score", "start")})
