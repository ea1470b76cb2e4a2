"""Topic lists, seed dialogues, dialogue CSVs, exported corpora.

Each reader keeps the file name and a position that follows the order of the
file, since row order is not a property of a Spark table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.text import strip_blanks
from parlance.schemas import DIALOGUE_CSV, SEED_DIALOGUE, TEST_CSV
from parlance.sources.folders import FILE, POS, scan


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """topic_pos, base_topic: one row per line, trimmed; blank lines stay.

    ``topic_pos`` is the start of the file block plus the line's number in
    it: in file order, unique per file, and found block by block.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
        strip_blanks(F.col("value")).alias("base_topic"),
    )
    w = Window.partitionBy("_file", "_block").orderBy("_line")
    return lines.select(
        (F.col("_block") + F.row_number().over(w) - 1).alias("topic_pos"), "base_topic"
    )


def read_seed_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """Seed dialogues as JSON lines; a missing id becomes the hash of the text."""
    rows = spark.read.schema(SEED_DIALOGUE).json(path)
    return rows.withColumn("id", F.coalesce("id", F.md5("dialogue")))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and quoted cells that may span lines; a file or a folder.

    Columns are found by name, others are passed over. An unreadable file is
    an error that names it; ``folders.scan`` sets such files aside instead.
    """
    found = scan(spark, path, schema)
    if found.errors:
        raise ValueError("; ".join(f"{p}: {e}" for p, e in sorted(found.errors.items())))
    return found.rows


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, DIALOGUE_CSV)


def read_test_set(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, TEST_CSV)


def read_corpus_split(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Exported train split, limited to id, dialogue and summary."""
    reader = spark.read.format(fmt)
    if fmt == "json":
        reader = reader.schema(SEED_DIALOGUE)
    return reader.load(path).select("id", "dialogue", "summary")


def base_name(file_name: Column) -> Column:
    """Text of a file's base name before its first underscore."""
    return F.split_part(F.substring_index(file_name, "/", -1), F.lit("_"), F.lit(1))


def run_label(model_id: str, file_name: Column) -> Column:
    """Model id with '/' and '-' as '_', then the file's base label."""
    return F.concat(F.translate(F.lit(model_id), "/-", "__"), F.lit("_"), base_name(file_name))
