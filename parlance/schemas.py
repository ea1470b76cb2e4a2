"""Column layouts of the tables that pass between stages."""

from pyspark.sql import types as T

TEXT = T.StringType()

SEED_DIALOGUE = T.StructType(
    [T.StructField("id", TEXT), T.StructField("dialogue", TEXT), T.StructField("summary", TEXT)]
)

DIALOGUE_CSV = T.StructType(
    [
        T.StructField("topic", TEXT),
        T.StructField("persona_1", TEXT),
        T.StructField("persona_2", TEXT),
        T.StructField("dialogue", TEXT),
        T.StructField("cot", TEXT),
    ]
)

TEST_CSV = SEED_DIALOGUE

PREDICTION_CSV = T.StructType(
    [
        T.StructField("dialogue", TEXT),
        T.StructField("predicted_summary", TEXT),
        T.StructField("summary", TEXT),
    ]
)

MESSAGE = T.StructType([T.StructField("role", TEXT), T.StructField("content", TEXT)])
MESSAGES = T.ArrayType(MESSAGE)

RESPONSE = T.StructType(
    [
        T.StructField("request_id", TEXT),
        T.StructField("response", TEXT),
        T.StructField("error", TEXT),
    ]
)

METRIC_ROW = T.StructType(
    [
        T.StructField("dialogue_id", TEXT),
        T.StructField("family", TEXT),
        T.StructField("metric", TEXT),
        T.StructField("value", T.DoubleType()),
    ]
)
