"""Session settings, shared scratch space and size-checked joins."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows up to which the small side of a lookup is sent to every executor. The
# count is taken before the join; a larger side goes through a salted join.
BROADCAST_ROWS = 100_000
SALTS = 32
# Arrow batches handed to Python end at this size, so that long texts cannot pile up.
BATCH_BYTES = 4 << 20


def build_session(name: str = "parlance", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
        # A model call must not be doubled by a speculative copy of its task.
        "spark.speculation": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. A local folder is made
    only where that is unset and the session runs in one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="parlance-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(scratch_root(spark), f"{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage in a way that outlives executors, and fixes the rows of a
    plan whose parts (model calls) must not be evaluated twice. ``codec`` is
    for tables of whole texts, where more work for fewer bytes pays.
    """
    path = scratch_path(df.sparkSession, label)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "inner",
    salt_by: Column | None = None,
    rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a large table, skewed on ``keys``, with one that is unique on them.

    A right side of checked size is broadcast. Otherwise it is repeated once
    per salt, so the rows of one hot key spread over ``SALTS`` tasks.
    ``how`` is inner, left, left_semi or left_anti.
    """
    if small_enough(right, rows):
        return left.join(F.broadcast(right), keys, how)
    spread = F.xxhash64(salt_by if salt_by is not None else F.struct(*left.columns))
    salted = left.withColumn("_salt", F.pmod(spread, F.lit(SALTS)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, where it is not installed, and bound their batches by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_parlance_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="parlance-zip-"), "parlance.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, str(file.relative_to(root.parent)))
    # Spark copies the archive to every executor.
    context.addPyFile(archive)
    context._parlance_shipped = True
