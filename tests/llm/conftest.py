import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    long = "word lorem, ipsum. " * 30_000
    texts = [None, "", " ", "one", "Two words", long, long + "x", "x" * 50_000, "é ▁ 😀\n\t\x00 end", "a b c d", "A b C d", "a b c d"]
    rows = [(k, t, "en" if k % 2 else None, None, len(t) if t else None) for k, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, "nobody's text here", None, "src0", 18), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, DOCUMENTS)
    from pyspark.sql import functions as F

    extra = ["fp", "ids", "path", "crc", "at", "u", "root", "node", "start", "shard", "bucket", "score", "text.length"]
    return frame.select("*", *(F.lit(7).alias(c) for c in extra))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)
