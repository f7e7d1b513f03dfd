import pytest
from pyspark.sql import types as T

LONG_TEXT = "Café alpha bravo, charlie delta. " * 3000

#: Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns whose names clash with inner ones.
ROWS = [
    (1, "", "en", "a", 0, "x", 1),
    (2, None, "en", "a", None, "x", None),
    (3, LONG_TEXT, None, None, len(LONG_TEXT), None, 2),
    (4, "one two three four five six seven", "en", "b", 33, "y", 3),
    (4, "one two three four five six seven", "en", "b", 33, "y", 3),
    (5, "One two THREE four five six seven", "en", "b", 33, "y", 3),
    (None, "one two three four five six seven", "en", "b", 33, "z", 4),
    (None, None, None, None, None, None, None),
    (6, " \t\n ", "en", "b", 4, "z", 5),
    (7, "mail a.b@c.example.org or +1 (555) 010-2030 or 4539 1488 0343 6467 or 10.0.0.255 now", "en", "c", 80, "z", 6),
    (8, "Ünï😀cödé 　 漢字 e@f.gh \x00 \x1c end", "xx", "c", 30, "z", 7),
]
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("spans", T.StringType()), T.StructField("fp", T.IntegerType()),
])


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
