"""Tables that the tests of this folder share."""

import pytest
from pyspark.sql import types as T

DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # names that the operators use themselves or return
    T.StructField("_row", T.StringType()), T.StructField("size", T.StringType()),
    T.StructField("score", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("length", T.StringType()), T.StructField("root", T.StringType()),
])


def doc(doc_id, text, source="a"):
    return (doc_id, text, None, source, None, "x", None, "s", "i", "l", "r")


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table with clashing extra columns from (id, text, source)."""
    def make(*rows):
        return spark.createDataFrame([doc(*r) for r in rows], DOC_SCHEMA)
    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and long texts, ties and repeated rows."""
    words = " ".join(f"word{i % 977}" for i in range(30_000))
    return make_docs(
        (1, "alpha beta gamma delta", "b"), (2, "alpha  beta\tgamma\ndelta", "a"), (3, None, "a"),
        (4, "", None), (5, "   \n", "a"), (6, words, "b"), (7, words + " tail", "b"),
        (8, "Alpha Beta Gamma Delta", "c"), (8, "Alpha Beta Gamma Delta", "c"), (None, "lost id", None),
        (None, "lost id", None), (None, None, "a"), (9, "one", "c"), (10, "naïve café été", "a"),
        (11, "x" * 70, "b"), (12, "x" * 70 + " y", "b"))


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs()
