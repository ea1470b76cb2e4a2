"""Stage tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(target)


def finished(spark: SparkSession, path: str) -> bool:
    """True when a job has committed a table there."""
    return exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def save_stage(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Overwrite a stage table and read it back.

    With ``partition_by`` only the partitions present in ``df`` are replaced,
    so one topic can be saved without touching the others.
    """
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_counted(
    df: DataFrame, path: str, partition_by: list[str] | None = None
) -> tuple[DataFrame, int]:
    """``save_stage`` and the number of rows, counted by the write itself."""
    seen = Observation()
    table = save_stage(df.observe(seen, F.count(F.lit(1)).alias("rows")), path, partition_by)
    return table, seen.get["rows"]


def export_csv(df: DataFrame, path: str) -> None:
    """CSV whose quoted cells keep line breaks, quotes and blanks."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("quoteAll", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def append_report(report: DataFrame, path: str) -> None:
    report.write.mode("append").parquet(path)
