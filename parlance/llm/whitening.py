"""Embedding whitening from a bit-sliced scatter matrix.

Every entry c of a vector becomes the integer x = floor(64 c) + 1000000. Less
its dimension's smallest value it is a small unsigned number y, whose bit b over
64 rows is one word of the bit plane (dimension, b). The cross-product of two
dimensions is then exact:

    sum(y_i y_j) = sum over a, b of 2^(a+b) popcount(plane(i, a) & plane(j, b))

and so are the sums T_i. A task packs its rows and returns the totals of
the dimension pairs as longs (in limbs of 16 weight bits, one limb while a
dimension has at most 8 bits); Spark adds them up. On the driver, which holds
the dimensions squared and no rows, n sum(y_i y_j) - T_i T_j is the centred
scatter as an exact integer, and only then does it become a double for ``eigh``.
The smallest values cancel in it, as they do in n x - S = n y - T.

Defined results: rows whose vector is null, empty, or holds a null or non-finite
entry, and vectors of another length than most (the shortest of equals), are
dropped; zero vectors stay, as do rows with a null id and repeated rows, each on
its own. x saturates at +-2^62 + 1000000. Components whose eigenvalue does not
exceed the rounding of the largest one (dimensions x 2^-52 of it) hold no spread:
whitened is null there and ``identity_error`` leaves them out; with no other
component it is 0. ``deviation`` is a decimal, null beyond 38 digits. No usable
row: an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.ann import common_length, matrix
from parlance.llm.common import prepare, slices
from parlance.session import materialize

SCALE, OFFSET, MOST = 64.0, 1_000_000, 1 << 62
COMPONENTS = 32
# Rows packed at a time: 256 words a plane.
ROWS = 16_384
LIMB_BITS = 16


def finite(vector: Column) -> Column:
    """Not null, not empty, and only finite entries."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


def integers(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        floor = np.floor(SCALE * vectors.astype(np.float64))
    return np.clip(floor, -MOST, MOST).astype(np.int64) + OFFSET


def shifted(x: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (x - low).astype(np.uint64)


def planes(y: np.ndarray, bits: int) -> np.ndarray:
    """Words of the bit planes, [dimension, bit, word]; rows beyond the last are zeros."""
    n, dims = y.shape
    words = -(-n // 64)
    out = np.zeros((dims, bits, words), np.uint64)
    for b in range(bits):
        ones = ((y >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T
        padded = np.zeros((dims, words * 64), np.uint8)
        padded[:, :n] = ones
        out[:, b] = np.packbits(padded, axis=1).view(np.uint64)
    return out


class Scatter:
    """Exact sums and cross-products of the rows added, in limbs: total = sum of limb[l] * 2^(16 l)."""

    def __init__(self, dims: int, bits: int):
        self.dims, self.bits = dims, bits
        self.limbs = max(1, -(-(2 * bits - 1) // LIMB_BITS))
        self.cross = np.zeros((self.limbs, dims, dims), np.int64)
        self.sums = np.zeros((self.limbs, dims), np.int64)
        # weight[a, b, l]: 2^(a+b) as seen by limb l.
        self.weight = np.zeros((bits, bits, self.limbs), np.int64)
        for a in range(bits):
            for b in range(bits):
                self.weight[a, b, (a + b) // LIMB_BITS] = 1 << (a + b) % LIMB_BITS

    def add(self, y: np.ndarray) -> None:
        for start, end in slices(len(y), ROWS):
            packed = planes(y[start:end], self.bits)
            for i in range(self.dims):
                for a in range(self.bits):
                    both = np.bitwise_count(packed[i:] & packed[i, a]).sum(2, dtype=np.int64)
                    self.cross[:, i, i:] += (both @ self.weight[a]).T
            alone = np.bitwise_count(packed).sum(2, dtype=np.int64)
            self.sums += (alone @ self.weight[:, 0]).T


@dataclass
class Model:
    """Integers n, low, T and the eigenvectors (columns) with their values, largest first."""

    n: int
    low: np.ndarray
    totals: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    holds: np.ndarray

    def deviations(self, y: np.ndarray) -> np.ndarray:
        """n x - S of every entry: longs where they fit, otherwise Python integers."""
        top = int(y.max(initial=0)) * self.n
        if max(top, *self.totals) < 1 << 62:
            return self.n * y.astype(np.int64) - np.array(self.totals, np.int64)
        return self.n * y.astype(object) - np.array(self.totals, object)

    def squares(self, off: np.ndarray) -> list[int | None]:
        """Sum of the squared deviations of each row; None beyond 38 digits."""
        if off.dtype != object and np.abs(off).max(initial=0) < int(np.sqrt((1 << 62) / max(1, off.shape[1]))):
            return (off * off).sum(1).tolist()
        whole = (off.astype(object) ** 2).sum(1).tolist()
        return [v if v < 10**38 else None for v in whole]

    def whiten(self, off: np.ndarray) -> np.ndarray:
        """Components of the centred rows over the roots of their eigenvalues; NaN where they hold no spread."""
        centred = (off / self.n).astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.holds, centred @ self.vectors / np.sqrt(np.where(self.holds, self.values, 1)), np.nan)


def solve(n: int, low: np.ndarray, totals: list[int], cross: np.ndarray, components: int = COMPONENTS) -> Model:
    """``cross`` holds exact Python integers, its upper triangle at least."""
    dims = len(totals)
    cov = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            # Integers divide with a single rounding.
            cov[i, j] = cov[j, i] = (n * cross[i, j] - totals[i] * totals[j]) / (n * n)
    # Scaled by a power of two, so that no square leaves the range.
    unit = 2.0 ** np.frexp(np.abs(cov).max() or 1.0)[1]
    values, vectors = np.linalg.eigh(cov / unit)
    values, vectors = values[::-1] * unit, vectors[:, ::-1]
    trace = float(np.trace(cov))
    kept = slice(0, min(components, dims))
    holds = values > dims * 2.0**-52 * max(values[0], 0)
    explained = np.maximum(values, 0) / trace if trace > 0 else np.zeros(dims)
    return Model(n, low, totals, vectors[:, kept], values[kept], explained[kept], holds[kept])


def usable_rows(rows: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, embedding of the fit list, and its number of dimensions (0: no row)."""
    good = rows.select("vec_id", "embedding").where(finite(F.col("embedding")))
    dims = common_length(good) or 0
    return good.where(F.size("embedding") == dims), dims


def _lowest(rows: DataFrame, dims: int) -> tuple[int, np.ndarray, int]:
    """Number of rows, smallest x of every dimension, and the bits that the largest y needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = integers(matrix(batch.column(0), dims))
                n += len(x)
                low = x.min(0) if low is None else np.minimum(low, x.min(0))
                high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(dims, n)), pa.array(np.arange(dims)), pa.array(low), pa.array(high)], ["n", "d", "low", "high"]
            )

    found = rows.select("embedding").mapInArrow(run, "n long, d long, low long, high long").groupBy("d").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
    ).orderBy("d").toArrow()  # a row per dimension
    low, high = (found.column(c).to_numpy().astype(np.int64) for c in ("low", "high"))
    return found.column("n")[0].as_py(), low, int(shifted(high, low).max()).bit_length() or 1


def scatter(rows: DataFrame, dims: int, low: np.ndarray, bits: int) -> tuple[list[int], np.ndarray]:
    """Sums T and cross-products of y over all rows, as Python integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = Scatter(dims, bits), [], 0
        for batch in batches:
            held.append(shifted(integers(matrix(batch.column(0), dims)), low))
            size += batch.num_rows
            if size >= ROWS:
                total.add(np.concatenate(held))
                held, size = [], 0
        if size:
            total.add(np.concatenate(held))
        # Cells of the upper triangle by rows, then the sums.
        upper = np.triu_indices(dims)
        for limb in range(total.limbs):
            values = np.concatenate([total.cross[limb][upper], total.sums[limb]])
            cells = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cells), limb, np.int32)), pa.array(cells.astype(np.int64)), pa.array(values[cells])],
                ["limb", "cell", "total"],
            )

    parts = rows.select("embedding").mapInArrow(run, "limb int, cell long, total long")
    found = parts.groupBy("limb", "cell").agg(F.sum("total").alias("total")).toArrow()  # dimensions squared
    i, j = np.triu_indices(dims)
    totals, cross = [0] * dims, np.zeros((dims, dims), object)
    for limb, cell, value in zip(*(found.column(c).to_pylist() for c in ("limb", "cell", "total"))):
        if cell < len(i):
            cross[i[cell], j[cell]] += value << LIMB_BITS * limb
        else:
            totals[cell - len(i)] += value << LIMB_BITS * limb
    return totals, cross


def fitted(rows: DataFrame, dims: int, components: int = COMPONENTS) -> Model:
    n, low, bits = _lowest(rows, dims)
    return solve(n, low, *scatter(rows, dims, low, bits), components)


def whitened(rows: DataFrame, model: Model, dims: int) -> DataFrame:
    """vec_id, deviation decimal(38), whitened array<double> (null without spread) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(batch.num_rows, ROWS):
                part = batch.slice(start, end - start)
                off = model.deviations(shifted(integers(matrix(part.column(1), dims)), model.low))
                flat = model.whiten(off)
                values = pa.array(flat.ravel(), mask=np.isnan(flat).ravel())
                lists = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32), values)
                squares = pa.array([None if v is None else str(v) for v in model.squares(off)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), squares, lists], ["vec_id", "deviation", "whitened"])

    out = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(
        run, "vec_id long, deviation string, whitened array<double>"
    )
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def identity_error(table: DataFrame, model: Model) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity.

    The rows are centred already, by their exact means, so their products need
    no further centring.
    """
    held = np.flatnonzero(model.holds)
    if not len(held):
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(held), len(held)))
        for batch in batches:
            w = matrix(batch.column(0), len(model.holds))[:, held]
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "total"])

    sums = table.select("whitened").mapInArrow(run, "cell long, total double").groupBy("cell").agg(F.sum("total").alias("total"))
    found = sums.orderBy("cell").toArrow().column("total").to_numpy()  # components squared
    return float(np.abs(found.reshape(len(held), -1) / model.n - np.eye(len(held))).max())


def whitening(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of ``rows`` (vec_id, embedding)."""
    spark = rows.sparkSession
    prepare(spark)
    rows, dims = usable_rows(rows)
    if not dims:
        return spark.createDataFrame([], (
            "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        ))
    model = fitted(rows, dims, components)
    table = materialize(whitened(rows, model, dims), "whitened")
    error = identity_error(table, model)
    shares = F.array(*[F.lit(float(v)) for v in model.explained])
    return table.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
