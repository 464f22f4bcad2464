import pytest

pytest.importorskip("public_tokenizers")

#: Rows that every operator must take: nulls, empty texts, repeats, ties.
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "One two three four five six seven."),
    (4, "One two three four five six seven."),
    (5, "One two three four five six seven."),
    (None, "a row without an id, with words"),
    (None, None),
    (6, "short"),
    (7, "é🙂日本 ▁ \x00   x"),
    (8, "word " * 30_000),
]


@pytest.fixture(scope="session")
def make(spark):
    """A frame of (doc_id, text), if asked for with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    def frame(rows, clash=False):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        if clash:
            for c in ("keep_id", "kept", "fp", "key", "n", "recipe", "label", "low", "score", "spans", "sketch", "next", "bucket", "b", "copy", "ids", "length", "start", "__gone", "__pii"):
                df = df.withColumn(c, F.lit("clash"))
        return df

    return frame


@pytest.fixture(scope="session")
def sample():
    """Documents of the driver's table at the small scale: (doc_id, text)."""
    import duckdb

    return duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
