"""Training sets: summary pairs and context/response pairs, by split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import context_response
from parlance.operators.sampling import size_matched

# Fixed value: seed of the size-matched sample.
SEED = 42


def summary_pairs(rows: DataFrame) -> DataFrame:
    return rows.select("id", "dialogue", "summary")


def response_pairs(rows: DataFrame) -> DataFrame:
    """id, context, response; dialogues of one line have none."""
    pairs = rows.select("id", context_response(F.col("dialogue")).alias("_p"))
    return pairs.where(F.col("_p").isNotNull()).select("id", "_p.context", "_p.response")


def with_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


def training_sets(
    synthetic: DataFrame, in_domain: DataFrame, test: DataFrame, kind: str = "response", seed: int = SEED
) -> DataFrame:
    """dataset, split and pair columns.

    ``synthetic`` trains on the generated dialogues and ``in_domain`` on as
    many rows of the reference corpus; both are tested on the same rows. Fewer
    rows in the corpus are an error.
    """
    if kind not in ("summary", "response"):
        raise ValueError(f"unknown kind: {kind}")
    pairs = response_pairs if kind == "response" else summary_pairs
    generated, held_out = pairs(synthetic), pairs(test)
    matched = size_matched(pairs(in_domain), ["id"], generated, seed)
    return (
        with_splits(generated, held_out).withColumn("dataset", F.lit("synthetic"))
        .unionByName(with_splits(matched, held_out).withColumn("dataset", F.lit("in_domain")))
    )
