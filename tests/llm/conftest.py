import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("key", T.StringType()),
        T.StructField("fp", T.StringType()), T.StructField("h", T.StringType()),
    ]
)
LONG = " ".join(f"word{i % 997}x{i}" for i in range(60_000))
SHARED = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def rows():
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, clashing column names."""
    base = [
        (1, "The quick brown fox. " + SHARED, "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, "   \n\t ", "de", "a"), (5, "einfach so, und Ärger über Öl", "de", None),
        (6, SHARED + " tail end of it", "en", "b"), (6, SHARED + " tail end of it", "en", "b"), (None, SHARED, None, "b"), (None, None, None, None), (8, LONG, "en", "b"),
        (9, LONG + " more", "en", "b"), (10, "x", "fr", "a"), (11, "... !!! 123 456", "fr", "a"), (12, 'token = "0123456789abcdef0123456789abcdef01234567" 4111 1111 1111 1111', "en", "a"),
        (13, "one two three one two three one two three one two three one two three one two three one two three", "en", "a"), (14, "été déjà là où ça naïve ça été", "fr", "c"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), "k", "f", "h") for i, t, lang, s in base]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(df):
    return [r.asDict() for r in df.collect()]
