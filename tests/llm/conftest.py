import pytest

#: Rows of documents with the cases every operator must handle, and columns whose names operators might use themselves.
EDGES = [
    (1, "The cat sat on the mat. The dog ran off.", "en", "a"),
    (2, "the CAT sat on the mat. The dog ran off.", "en", "b"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, "   \t\n ", "de", "a"),
    (6, "x", None, "b"),
    (7, "word " * 9000, "en", "c"),
    (8, "Ünïcödé ÄÖÜ straße 日本語 😀 <|endoftext|> don't we'LL", "fr", None),
    (9, "1234 5678 ## !!", "en", "a"),
    (None, "a row without an id here", "en", "a"),
    (10, "a row that repeats as it is, twice over", "en", "d"),
    (10, "a row that repeats as it is, twice over", "en", "d"),
]
CLASHING = ["n", "text_sha256", "score", "name", "w", "id", "rank", "size", "target", "range", "fingerprint", "__x", "__id", "__n", "__k", "key", "own", "bad", "line", "site", "dropped", "drop", "nth", "sha", "gone", "same", "sig", "band", "times", "host", "label", "h", "next_text", "edited"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGES, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("bigint"))
    return df.withColumns({c: F.lit("taken") for c in CLASHING}).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents of the smallest tables, if they are here."""
    import os

    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("driver tables are absent")
    return spark.read.parquet(f"{path}/documents.parquet")
