"""The corpus pipeline: quality, near copies, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.llm import bpe, mixing, pii, quality, simhash
from parlance.llm.common import prepare, table
from parlance.llm.queries import tokenizer_path
from parlance.operators.sampling import with_position
from parlance.session import lookup_join, materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of four words, four bits at most."""
    return simhash.keep_one(docs, words=4, budget=4)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind in brackets."""
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequence: documents once per pass of the mix, in the order of the curriculum."""
    return mixing.curriculum(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """position, doc_id, lang, source, n_tokens, ids of each document, in the order of the sequence.

    ``position`` is the number of the row in the files of ``docs``, which the
    stage before wrote in the order of the curriculum.
    """
    prepare(spark)
    numbered = in_file_order(docs.select("doc_id", "lang", "source", "text"))
    coded = bpe.encode(numbered, tokenizer_path())
    rows = coded.select("_row.*", F.size("ids").cast("long").alias("n_tokens"), "ids")
    rows = rows.select("position", "doc_id", "lang", "source", "n_tokens", "ids")
    # Positions are dense, so a row's part follows from them: no sampling, which would encode twice.
    parts, n = int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, docs.count())
    part = F.least((F.col("position") * parts / n).cast("int"), F.lit(parts - 1))
    return rows.repartitionById(parts, part).sortWithinPartitions("position")


def in_file_order(docs: DataFrame) -> DataFrame:
    """``docs`` with ``position``: the row's number from 0, files taken by name.

    Rows that were not read from files have the order of their partitions.
    """
    if not docs.inputFiles():
        return with_position(docs.withColumn("_at", F.monotonically_increasing_id()), "_at", "position").drop("_at")
    rows = docs.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    # A row per file: no more than the tasks that wrote them.
    files = rows.groupBy("_file").agg(F.count("*").alias("n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(files.select("_file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")), "files")
    numbered = lookup_join(rows, starts, ["_file"])
    return numbered.withColumn("position", F.col("_start") + F.col("_at")).drop("_file", "_at", "_start")


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_copies_stage),
    ("PII", pii_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", encoding_stage),
]

# Trained models, fingerprints and encodings are beyond SQL; tests/llm/test_pipeline.py holds run() against a plain chain.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
