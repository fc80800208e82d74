import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    base = "the quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak tree near a river"
    return [
        (0, None, "en", "src0", None), (1, "", "en", "src0", 0), (2, LONG, "en", "src0", 9), (3, base, "en", "src0", 1), (3, base, "en", "src0", 1),
        (4, base, None, "src1", 1), (5, base + " tonight", "de", None, 1), (6, "!!! ???", "fr", "src2", 3), (7, "one two", "fr", "odd", 2),
        (None, base, "en", "src0", 1), (8, "\x00\x01 ünïcode Straße naïve 中文 字", "de", "src3", 4), (9, "", None, None, None), (10, "ONE two", "fr", "src2", 2),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, DOCS)


@pytest.fixture(scope="session")
def clash_docs(edge_docs):
    """Extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    names = ["sw_row", "sw_words", "sw_hits", "sw_items", "tokens", "l_domain", "leaf", "key", "bucket", "shard", "slot", "h", "id", "label", "score", "ids", "held_out", "sw_gone", "copies", "n", "part", "range"]
    return edge_docs.select("*", *[F.lit("x").alias(n) for n in names])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}
