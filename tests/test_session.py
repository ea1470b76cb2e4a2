import pandas as pd
import pytest
from pyspark.sql import functions as F

from parlance import session


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_the_plain_one(spark, how):
    left = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"))
    right = spark.createDataFrame([(0, "a"), (3, "b"), (9, "c")], "k long, v string")
    want = sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
    for rows in (0, 10):
        got = session.lookup_join(left, right, ["k"], how, F.col("id"), rows=rows)
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_scratch_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert session.scratch_root(spark) == (named or spark.sparkContext.getCheckpointDir())


def test_materialize_keeps_rows_and_types(spark):
    df = spark.range(5).select("id", F.array(F.lit(1.5)).alias("a"))
    copy = session.materialize(df, "copy")
    assert copy.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(tuple, copy.collect())) == sorted(map(tuple, df.collect()))


def test_batches_for_python_are_bounded_by_bytes(spark):
    """Long texts do not pile up to the row limit of a batch."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    session.ship_package(spark)

    @F.pandas_udf("long")
    def held(texts: pd.Series) -> pd.Series:
        return pd.Series([len(texts)] * len(texts))

    rows = spark.range(0, 200, 1, 1).select(F.expr("repeat('x', 200000)").alias("t"))
    assert rows.select(held("t").alias("n")).agg(F.max("n")).head()[0] * 200_000 <= 2 * session.BATCH_BYTES
