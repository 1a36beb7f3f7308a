import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("score", T.StringType()),
        T.StructField("component_id", T.StringType()),
    ]
)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table, with two columns of clashing names, from texts or (id, text, lang) rows."""

    def make(rows):
        full = []
        for i, r in enumerate(rows):
            doc_id, text, lang = r if isinstance(r, tuple) else (i, r, None)
            full.append((doc_id, text, lang, None, None if text is None else len(text), "x", "y"))
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls, blanks, ties, repeats and a very long text."""
    return [None, "", "   \n\t", "one", "one", "a b", "word " * 30_000, "émile zola écrit", "x" * 50_000, "one two three four five six", "ONE TWO THREE FOUR FIVE SIX", "  ", "123 456", "🙂🙂 🙂"]
