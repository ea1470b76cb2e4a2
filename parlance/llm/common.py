"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.session import materialize, ship_package

# Arrow batches handed to Python end at this size, so long texts cannot pile up.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Give the workers this package and bound the Arrow batches by bytes."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def share(key: Column, rows: int, of: int) -> Column:
    """True for about 95 % of ``rows`` in a table of ``of`` rows, by a hash of ``key``; for all of a smaller table."""
    if of <= rows:
        return F.lit(True)
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(0.95 * rows / of * (1 << 30))


def thinned(df: DataFrame, key: Column, rows: int, of: int) -> DataFrame:
    """At most ``rows`` rows of a table of ``of`` rows, chosen by a hash of ``key``."""
    if of <= rows:
        return df
    return df.where(share(key, rows, of)).limit(rows)


def packed(df: DataFrame, *columns: Column) -> DataFrame:
    """All columns in one struct ``_row``, beside the computed ones: no names can clash."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_row"), *columns)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(n: int, step: int) -> Iterator[tuple[int, int]]:
    for start in range(0, n, step):
        yield start, min(n, start + step)


# ------------------------------------------------------------ connected classes


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smallest id of its class) that connect what the pairs u-v connect."""
    ids, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], least)
        np.minimum.at(after, label[b], least)
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        while not np.array_equal(shorter := after[after], after):
            after = shorter
        if np.array_equal(after, label):
            break
        label = after
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest id that edges a-b (longs) reach; ids without an edge are left out.

    Labels travel along the edges and then jump to their label's label, so the
    rounds grow with the logarithm of the longest path. Every round is written
    to the shared folder. The joins are on plain tables, so a hot centre is
    split by the adaptive skew join.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low"))
    labels = materialize(labels.select("id", F.least("id", "low").alias("component")), "labels")
    while True:
        near = (
            both.join(labels, both["b"] == labels["id"])
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        step = labels.join(near, "id").select(
            "id", F.col("component").alias("before"), F.least("component", "near").alias("low")
        )
        step = materialize(step, "labels")
        root = step.select(F.col("id").alias("low"), F.col("low").alias("component"))
        after = materialize(step.join(root, "low").select("id", "before", "component"), "labels")
        labels = after.select("id", "component")
        if after.where("before != component").isEmpty():
            return labels


# ------------------------------------------------------------- hashed trigrams

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def trigrams(data: list[bytes], dims: int, lower: bool = False) -> np.ndarray:
    """Counts of hashed byte trigrams, one row of ``dims`` (a power of two) per text."""
    counts = np.zeros((len(data), dims), np.float32)
    shift = np.uint32(32 - dims.bit_length() + 1)
    pending: list[tuple[int, bytes]] = []

    def count() -> None:
        size = np.array([len(t) for _, t in pending])
        raw = np.frombuffer(b"".join(t for _, t in pending), np.uint8)
        x = (_LOWER[raw] if lower else raw).astype(np.uint32)
        h = x[:-2] * np.uint32(2654435761) + x[1:-1] * np.uint32(2246822519) + x[2:] * np.uint32(3266489917)
        h ^= h >> np.uint32(15)
        h *= np.uint32(668265263)
        h >>= shift
        row = np.repeat(np.arange(len(pending), dtype=np.int64), size)
        whole = row[:-2] == row[2:]
        bins = (row[:-2] * dims + h)[whole]
        got = np.bincount(bins, minlength=len(pending) * dims).reshape(len(pending), dims)
        for k, (i, _) in enumerate(pending):
            counts[i] += got[k]
        pending.clear()

    held = 0
    for i, t in enumerate(data):
        # A long text goes in pieces that overlap by two bytes.
        for start in range(0, max(1, len(t) - 2), 1 << 20):
            piece = t[start : start + (1 << 20) + 2]
            pending.append((i, piece))
            held += len(piece)
            if held >= 1 << 20 or len(pending) >= 256:
                if held >= 3:
                    count()
                pending.clear()
                held = 0
    if held >= 3:
        count()
    return counts
