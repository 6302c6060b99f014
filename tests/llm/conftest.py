import pytest
from pyspark.sql import types as T

#: Rows with every awkward case: null id, null and empty text, ties, repeats, long texts, odd white space, clashing columns.
AWKWARD = [
    (5, "The quick brown fox jumps over the lazy dog and then it runs away home", "en", "a"),
    (3, "the QUICK brown fox jumps over the lazy dog and then it runs away home", "en", "a"),
    (9, None, "en", None), (10, "", None, "b"), (11, " \n\t ", "fr", "b"), (None, "un deux trois", "fr", "b"),
    (7, "same row", "en", "a"), (7, "same row", "en", "a"), (8, "a  b c \u0085d\x1ce 'll <|endoftext|> x\n\n y ", "en", "a"),
    (12, "Ünïcode ÀÉ ẞß ΑΣ’s 日本語 текст 12345 don't! \U0001F600 é", "de", "c"),
    (13, " ".join(f"word{i % 997} the" for i in range(20000)), "en", "c"),
    (14, "x" * 70000, "en", "c"), (15, "a\nb\nA\nb\n\nb", "en", "c"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with a column for each name that an operator might use inside."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("fp", T.StringType()), T.StructField("Key", T.StringType()),
                           T.StructField("rate_source", T.StringType()), T.StructField("id", T.IntegerType()),
                           T.StructField("kept_id", T.StringType()), T.StructField("start", T.StringType())])
    return spark.createDataFrame([(*r, None, "k", "r", 1, "s", None) for r in AWKWARD], schema)


@pytest.fixture(scope="session")
def none(awkward):
    return awkward.limit(0)
