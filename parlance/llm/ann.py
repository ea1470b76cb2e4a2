"""Nearest neighbours by randomly rotated one-bit codes.

A vector's difference from the centre is rotated by a fixed random orthogonal
matrix; its code is the signs of the result, one bit a component, with the
inner product of the difference and the code's direction as correction scalar.
What that leaves over is coded again, ``LEVELS`` times in all, and the length of
the last remainder is the second scalar. A query's rotation is quantised to
``QUERY_BITS`` bits; popcounts of its bit planes with the packed codes estimate
its inner product with every row, off by the last remainder's share, which for
a random rotation has a standard deviation of |remainder| |query| / sqrt(dims - 1),
and by the quantisation. Both, ``ERROR`` times, bound the error.

Within a block of rows a query reranks, by the exact inner product of the
original vectors in double precision, every row whose upper bound reaches the
query's k-th largest lower bound. A block's best k go on, packed in one row, and
the best k of all blocks are the result.

Rows and queries are dealt into blocks of ``BLOCK`` rows and ``ASK`` queries by
a hash of the id, so copies of one vector spread evenly; every query block
meets every row block. The centre is the mean of a sample of ``SAMPLE`` rows;
every row gets a code.

Defined results: vectors that are null, zero, or hold null or non-finite
components, those of another length than most, and rows with a null id take no
part. Of rows that repeat a query's id the smallest vector asks; none of them
is its own candidate. Other repeated rows are candidates each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import prepare, thinned
from parlance.session import materialize

K, EVERY = 20, 20
BLOCK, ASK, SAMPLE = 16_384, 1_024, 10_000
LEVELS, QUERY_BITS, ERROR = 4, 7, 3.0


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits packed in 64-bit words."""
    n, dims = bits.shape
    padded = np.zeros((n, -(-dims // 64) * 64), np.uint8)
    padded[:, :dims] = bits
    return np.packbits(padded, axis=1).view(np.uint64)


def usable(vector: Column) -> Column:
    """Not null, not zero, and only finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def common_length(rows: DataFrame) -> int | None:
    """The length that most vectors have, the smallest of equals."""
    top = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    found = top.orderBy(F.desc("n"), "d").limit(1).collect()
    return found[0]["d"] if found else None


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dims)


class Coder:
    """Rotation, centre and the one-bit codes."""

    def __init__(self, dims: int, centre: np.ndarray, seed: int = 1):
        self.dims, self.centre = dims, centre
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
        self.rotation = q * np.sign(np.diag(r))

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed sign bits [row, level, word] and scalars [row, level + 1]: alignments, length of the remainder."""
        rest = (vectors - self.centre) @ self.rotation
        root, codes, scalars = np.sqrt(self.dims), [], []
        for _ in range(LEVELS):
            up = rest > 0
            codes.append(words(up))
            scalars.append(np.abs(rest).sum(1) / root)
            rest = rest - scalars[-1][:, None] * np.where(up, 1 / root, -1 / root)
        # Scaled by the largest component, so that no square leaves the range.
        top = np.abs(rest).max(1, initial=0)
        scalars.append(np.linalg.norm(rest / np.where(top > 0, top, 1)[:, None], axis=1) * top)
        return np.stack(codes, 1), np.stack(scalars, 1)

    def planes(self, turned: np.ndarray) -> tuple[np.ndarray, float, float]:
        """Bit planes of a quantised rotated query, its least component and the step."""
        low, top = float(turned.min()), (1 << QUERY_BITS) - 1
        step = (float(turned.max()) - low) / top or 1.0
        u = np.clip(np.rint((turned - low) / step), 0, top).astype(np.int64)
        return words(((u >> np.arange(QUERY_BITS)[:, None]) & 1).astype(np.uint8)), low, step

    def estimates(self, turned: np.ndarray, codes: list[np.ndarray], ones: list[np.ndarray], scalars: np.ndarray,
                  error: float) -> tuple[np.ndarray, np.ndarray]:
        """About <difference, query> of every row, and the bound of the error, for a query of length one."""
        planes, low, step = self.planes(turned)
        root = np.sqrt(self.dims)
        weights = (np.unpackbits(planes.view(np.uint8), axis=1).sum(1, dtype=np.int64) << np.arange(QUERY_BITS)).sum()
        total = low * self.dims + step * weights
        guess = np.zeros(len(scalars))
        for level, (code, count) in enumerate(zip(codes, ones)):
            up = np.zeros(len(code), np.int64)
            for b, plane in enumerate(planes):
                up += _popcount(code & plane) << b
            # Components of the query where the sign is up, less those where it is down.
            guess += scalars[:, level] * ((2 * (low * count + step * up) - total) / root)
        noise = step / np.sqrt(12) * np.sqrt((scalars[:, :-1] ** 2).sum(1))
        return guess, error * (scalars[:, -1] / np.sqrt(max(1, self.dims - 1)) + noise)

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, vectors: np.ndarray,
               codes: np.ndarray, scalars: np.ndarray, k: int, error: float):
        """For each query: ids and exact inner products of the block's best ``k`` rows, and the rows reranked."""
        # A query ranks rows alike at any length, and so do all rows scaled together.
        asked = queries / np.abs(queries).max(1, keepdims=True)
        asked = asked / np.linalg.norm(asked, axis=1, keepdims=True)
        far = np.abs(self.centre).max(initial=0) * np.sqrt(self.dims)
        big = max(float(scalars.max(initial=0)), float(far)) or 1.0
        turned, base, scaled = asked @ self.rotation, asked @ (self.centre / big), scalars / big
        levels = [np.ascontiguousarray(codes[:, level]) for level in range(codes.shape[1])]
        ones = [_popcount(code) for code in levels]
        for i in range(len(queries)):
            guess, wide = self.estimates(turned[i], levels, ones, scaled, error)
            own_row = ids == own[i]
            about, slack = guess + base[i], wide + 1e-12 * self.dims
            low = np.where(own_row, -np.inf, about - slack)
            floor = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
            near = np.flatnonzero((about + slack >= floor) & ~own_row)
            score = (vectors[near] * queries[i]).sum(1)
            best = np.lexsort((ids[near], -score))[:k]
            yield ids[near][best], score[best], len(near)


def _popcount(packed: np.ndarray) -> np.ndarray:
    counts = np.bitwise_count(packed)
    return counts[:, 0].astype(np.int64) if counts.shape[1] == 1 else counts.sum(1, dtype=np.int64)


def search(
    rows: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, ask: int = ASK, error: float = ERROR
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows with the largest inner product for each query.

    Both tables have ``vec_id`` and ``embedding``.
    """
    spark = rows.sparkSession
    prepare(spark)
    good = lambda t: t.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows, queries = good(rows), good(queries)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = common_length(rows)
    if dims is None:
        return empty
    rows = rows.where(F.size("embedding") == dims)
    queries = queries.where(F.size("embedding") == dims).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n, asked = rows.count(), queries.count()
    sample = matrix(thinned(rows, F.col("vec_id"), SAMPLE, n).select("embedding").toArrow().column(0), dims)
    coder = Coder(dims, sample.astype(np.float64).mean(0))
    row_blocks, query_blocks = -(-n // block), max(1, -(-asked // ask))
    spread = lambda key, parts: F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")

    def encode(batches):
        for batch in batches:
            v = matrix(batch.column(1), dims).astype(np.float64)
            binary = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            codes, scalars = coder.encode(v)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, binary(codes), binary(scalars)], ["vec_id", "embedding", "codes", "scalars"]
            )

    kind = rows.schema["embedding"].dataType.simpleString()
    coded = rows.mapInArrow(encode, f"vec_id long, embedding {kind}, codes binary, scalars binary")
    coded = materialize(coded, "codes")
    # A row's block is a hash of id and vector, so that a repeated id alone does not fill one block.
    grid = coded.withColumn("rb", spread(F.struct("vec_id", "embedding"), row_blocks)).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    )
    asks = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")).withColumn(
        "qb", spread(F.col("query_id"), query_blocks)
    ).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))

    def best(own: pa.Table, asking: pa.Table) -> pa.Table:
        shape = pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])
        if not len(own) or not len(asking):
            return shape.empty_table()
        ids = own.column("vec_id").to_numpy()
        vectors = matrix(own.column("embedding"), dims).astype(np.float64)
        codes = np.frombuffer(b"".join(own.column("codes").to_pylist()), np.uint64).reshape(len(ids), LEVELS, -1)
        scalars = np.frombuffer(b"".join(own.column("scalars").to_pylist()), np.float64).reshape(len(ids), -1)
        own_id = asking.column("query_id").to_numpy()
        q = matrix(asking.column("query"), dims).astype(np.float64)
        found = list(coder.search(q, own_id, ids, vectors, codes, scalars, k, error))
        return pa.table({"query_id": own_id, "ids": [f[0] for f in found], "scores": [f[1] for f in found]}, schema=shape)

    found = grid.groupBy("rb", "qb").cogroup(asks.groupBy("rb", "qb")).applyInArrow(
        best, "query_id long, ids array<long>, scores array<double>"
    )
    pairs = found.select("query_id", F.inline(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))))
    pairs = pairs.toDF("query_id", "vec_id", "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
