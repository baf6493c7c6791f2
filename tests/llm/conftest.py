import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls, empty and very long texts, repeated rows, clashing column names."""
    rows = [(1, "the quick brown fox jumps over the lazy dog", "en"), (2, None, "en"), (3, "", None), (4, " \t\n ", "en"),
            (None, "the quick brown fox jumps over the lazy dog", "en"), (None, None, None),
            (5, LONG, "en"), (6, "the  quick brown\nfox jumps over the lazy dog", "en"), (7, "Aa bb", "de"), (7, "Aa bb", "de"), (7, "other words", "de"),
            (8, "ünï cödé 中文 \U0001f600 \x00 end", None), (9, "<|endoftext|> </s> [INST] password=abcdefgh12345 ", "en"), (10, "Aa bb", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    df = df.withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    for c in ("score", "n", "v", "h", "_id", "_own", "_row", "_text", "keep_id", "part", "rank", "_word", "_bits", "_sha", "ids", "sig", "rep"):
        df = df.withColumn(c, F.lit(1))
    return df.repartition(3)


@pytest.fixture(scope="session")
def nobody(nasty):
    return nasty.where("doc_id = -1")
