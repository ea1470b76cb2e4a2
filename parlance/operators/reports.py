"""Folding scored rows into metrics per dialogue, document and run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def followup_scores(losses: DataFrame, key: str) -> DataFrame:
    """key, metric, value from rows of key, metric, polarity, loss.

    Mean loss of the negative follow-ups minus that of the positive ones; a
    side without follow-ups counts 0. A follow-up whose loss is missing makes
    the score null rather than a mean over fewer follow-ups.
    """

    def side(polarity: str):
        return F.coalesce(F.avg(F.when(F.col("polarity") == polarity, F.col("loss"))), F.lit(0.0))

    whole = F.count("loss") == F.count("*")
    return losses.groupBy(key, "metric").agg(
        F.when(whole, side("negative") - side("positive")).alias("value")
    )


def metric_maps(rows: DataFrame, keys: list[str], out: str = "metrics") -> DataFrame:
    """Map of metric to value per key; the metrics of a key are few and distinct."""
    return rows.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias(out)
    )


def long_metrics(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, metric, value from one column per metric."""
    return wide.unpivot(keys, [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")


def report(rows: DataFrame, run: list[str]) -> DataFrame:
    """run, metric, mean, scored, missing: the mean of each metric's values, and how many there are and are not.

    Partial means form before the shuffle, so few runs do no harm.
    """
    there = F.count("value")
    return rows.groupBy(*run, "metric").agg(
        F.avg("value").alias("mean"), there.alias("scored"), (F.count(F.lit(1)) - there).alias("missing")
    )


def mean_by_document(scores: DataFrame, key: str, value: str) -> DataFrame:
    return scores.groupBy(key).agg(F.avg(value).alias("mean"))
