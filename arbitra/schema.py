"""Types of decision data: one row is a state, a question about it, candidate answers and a target distribution."""

from pyspark.sql import types as T

KINDS = ("choice", "noul", "score")

DECISION = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("instructions", T.StringType()),
    T.StructField("candidates", T.ArrayType(T.StringType())),
    T.StructField("target", T.ArrayType(T.DoubleType())),
    T.StructField("kind", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("task", T.StringType()),
    T.StructField("original_split", T.StringType()),
    T.StructField("group_id", T.StringType()),
])

ENCODED = T.StructType([
    *DECISION.fields,
    T.StructField("input_ids", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("attention_mask", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("labels", T.ArrayType(T.DoubleType())),
])

#: Splits by rising priority; a group belongs to the highest that holds it.
SPLIT_PRIORITY = {"train": 0, "validation": 1, "calibration": 2, "test": 3}
SPLITS = tuple(SPLIT_PRIORITY)

#: Label sets of the known sources.
NLI = ["entailment", "neutral", "contradiction"]
RATINGS = ["1 star", "2 star", "3 stars", "4 stars", "5 stars"]
SENTIMENT = ["negative", "neutral", "positive"]
