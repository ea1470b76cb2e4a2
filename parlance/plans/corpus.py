"""Diversity of generated corpora, one row per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.operators import model
from parlance.operators.diversity import FILE_ROWS, cosine_row_maxima, rouge_row_maxima, taking_part
from parlance.operators.model import ClientFactory
from parlance.operators.reports import long_metrics
from parlance.session import materialize
from parlance.sources.folders import FILE, POS, scan
from parlance.sources.tables import append_report


def corpus_diversity(
    rows: DataFrame, file: str, order: list[str], text: str, client: ClientFactory, k: int | None = FILE_ROWS,
    store: str | None = None,
) -> DataFrame:
    """file, rows, rouge, cosine: means of the row maxima; null for a single row.

    The first ``k`` texts of each file take part, all of them for None. They are
    embedded once, through the ledger at ``store`` if there is one.
    """
    kept = materialize(taking_part(rows, file, order, text, k), "kept")
    vectors = model.embeddings(kept, [file, "_pos"], F.col(text), client, store)
    by_words = rouge_row_maxima(kept, file, "_pos", text)
    by_vectors = cosine_row_maxima(vectors.where(F.col("value").isNotNull()), file, "_pos", "value")
    # Both are keyed by (file, row), so the join has no hot key; a missing file's rows are told apart by their position.
    same = by_words[file].eqNullSafe(by_vectors[file]) & (by_words["_pos"] == by_vectors["_pos"])
    both = by_words.join(by_vectors, same, "left").select(by_words[file], "best_rouge", "best_cosine")
    return both.groupBy(file).agg(
        F.count("*").alias("rows"),
        F.avg("best_rouge").alias("rouge"),
        F.avg("best_cosine").alias("cosine"),
    )


def diversity_report(spark: SparkSession, folder: str, client: ClientFactory, report: str, run_id: str) -> DataFrame:
    """Append run_id, file_name, metric, value, error for every dialogue CSV of a folder.

    A file that cannot be read has one row with the reason; the others are measured.
    """
    found = scan(spark, folder, T.StructType([T.StructField("dialogue", T.StringType())]))
    rows = corpus_diversity(found.rows, FILE, [POS], "dialogue", client)
    run = F.lit(run_id).alias("run_id")
    scores = long_metrics(rows, [FILE], ["rouge", "cosine"]).select(
        run, FILE, "metric", "value", F.lit(None).cast("string").alias("error")
    )
    bad = found.files.where(F.col("error").isNotNull()).select(
        run, FILE, F.lit("unreadable").alias("metric"), F.lit(None).cast("double").alias("value"), "error"
    )
    table = materialize(scores.unionByName(bad), "diversity")
    append_report(table, report)
    return table
