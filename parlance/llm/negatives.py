"""Hard-negative mining with rotated one-bit codes.

Components become integers floor(256 x); a row's score is its integer inner
product with the anchor. For every anchor the operator finds its best positives
(same label), and for each of them the best negatives (other label) whose score
lies in a window below the positive's.

* Code. A row's integer vector is turned by a fixed random rotation. Its signs
  are a code of one bit a component; the code's direction c and the stored
  alignment f = <row, c> leave the residual row - f c. The residual is coded
  in the same way, ``LEVELS`` times in all, and the length of the last residual
  is stored.
* Estimate. The turned anchor is quantised to ``QUERY_BITS`` bits, and popcounts
  of its bit planes with the packed codes give the sum of f <anchor, c> over the
  levels.
* Interval. What the estimate leaves out is the anchor's product with the last
  residual r. As r is perpendicular to the last c, Cauchy-Schwarz bounds it by
  |r| sqrt(|anchor|^2 - <anchor, c>^2), for certain and not in probability; the
  anchor's quantisation error and the rounding of doubles are added.
* Filter. A row that cannot be among the best, by the k-th largest lower bound
  of the block's rows that certainly qualify, is passed over; the integer inner
  products of all others decide. So the result is exact.

Rows and anchors are dealt into blocks by a hash of id and vector, so equal rows
and hot labels spread; every anchor block meets every row block, in one task a
pair, which returns the k best of each anchor. A block holds ``BLOCK`` components
of rows, as the smallest integers that fit, beside their codes.

Defined results: rows with a null id or label, a null or empty vector, a null
or non-finite component, or a vector of another length than most (the shortest
of equals) take no part; zero vectors do. Components saturate at +-``limit``,
chosen so that a hundredfold score fits in a long (131072 * 256 / 2 at 64
dimensions). A row with the anchor's id is never its candidate; of rows
that repeat an anchor's id the one with the smallest label and vector asks.
Other repeated rows are candidates each. Ties go to smaller ids. Anchors
without a positive or a negative have no rows; an empty table gives none.
Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.ann import common_length, matrix, words
from parlance.llm.common import prepare, slices
from parlance.llm.whitening import finite
from parlance.session import materialize

SCALE, LEVELS, QUERY_BITS = 256.0, 5, 6
POSITIVES, NEGATIVES = 5, 5
LOW_SHARE, HIGH_SHARE = 80, 100
BLOCK, ASK = 1 << 20, 1 << 18
# Bounds on the rounding of doubles, relative to |anchor| |row| and absolute.
ROUNDING = 1e-9


def limit(dims: int) -> int:
    """Largest component size: a power of two with 100 * dims * size^2 within a long."""
    size = 1
    while 100 * dims * (2 * size) ** 2 < 1 << 63:
        size *= 2
    return size


def integers(vectors: np.ndarray, dims: int) -> np.ndarray:
    most = limit(dims)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * vectors.astype(np.float64)), -most, most).astype(np.int64)


def rotation(dims: int, seed: int = 1) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, turn: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Codes [row, level, word] and scalars [row, levels + 2]: alignments, length of the last residual, of the row."""
    rest = x @ turn
    root = np.sqrt(x.shape[1])
    codes, scalars = [], []
    length = np.linalg.norm(rest, axis=1)
    for _ in range(levels):
        up = rest > 0
        codes.append(words(up))
        align = np.abs(rest).sum(1) / root
        scalars.append(align)
        rest = rest - align[:, None] * np.where(up, 1 / root, -1 / root)
    return np.stack(codes, 1), np.stack([*scalars, np.linalg.norm(rest, axis=1), length], 1)


class Anchor:
    """A turned anchor's bit planes and the bounds of its quantisation."""

    def __init__(self, x: np.ndarray, turn: np.ndarray, bits: int = QUERY_BITS):
        q = x @ turn
        self.dims, self.length = len(q), float(np.linalg.norm(q))
        self.low = float(q.min())
        self.step = (float(q.max()) - self.low) / ((1 << bits) - 1) or 1.0
        u = np.clip(np.rint((q - self.low) / self.step), 0, (1 << bits) - 1).astype(np.int64)
        self.planes = words(((u >> np.arange(bits)[:, None]) & 1).astype(np.uint8))
        about = self.low + self.step * u
        self.total = float(about.sum())
        # |<q - about, signs>| is at most this, whatever the signs.
        self.error = float(np.abs(q - about).sum())

    def interval(self, codes: np.ndarray, scalars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the inner product with every coded row."""
        root = np.sqrt(self.dims)
        levels = codes.shape[1]
        guess, slack = np.zeros(len(codes)), np.zeros(len(codes))
        for level in range(levels):
            ones = np.bitwise_count(codes[:, level]).sum(1, dtype=np.int64)
            up = np.zeros(len(codes))
            for b, plane in enumerate(self.planes):
                up += np.bitwise_count(codes[:, level] & plane).sum(1, dtype=np.int64) << b
            # Components of the anchor where the sign is up, less those where it is down.
            dot = (2 * (self.low * ones + self.step * up) - self.total) / root
            guess += scalars[:, level] * dot
            slack += scalars[:, level] * (self.error / root)
        along = np.maximum(np.abs(dot) - self.error / root, 0)
        beside = np.sqrt(np.maximum(self.length**2 * (1 + ROUNDING) - along**2, 0))
        slack += scalars[:, levels] * beside + ROUNDING * (1 + self.length * scalars[:, levels + 1])
        return guess - slack, guess + slack


def best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to smaller ids."""
    return np.lexsort((ids, -score))[:k]


def kth(values: np.ndarray, k: int) -> float:
    """The ``k``-th largest value; minus infinity where there are fewer."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def closest(anchor: Anchor, x: np.ndarray, own: np.ndarray, rows: np.ndarray, ids, vectors, codes, scalars, k: int):
    """Places, scores and number of integer-scored rows: the ``k`` best of ``rows``."""
    low, high = anchor.interval(codes[rows], scalars[rows])
    near = rows[high >= kth(low, k)]
    score = vectors[near].astype(np.int64) @ x
    top = best(ids[near], score, k)
    return near[top], score[top], len(near)


def windowed(anchor: Anchor, x: np.ndarray, ceilings: list[int], rows: np.ndarray, ids, vectors, codes, scalars, k: int,
             low_share: int, high_share: int):
    """(ceiling, places, scores) of the ``k`` best in each ceiling's window, and the number of integer-scored rows."""
    low, high = anchor.interval(codes[rows], scalars[rows])
    wanted = np.zeros(len(rows), bool)
    for p in ceilings:
        floor, ceiling = low_share * p / 100, high_share * p / 100
        sure = (low >= floor) & (high <= ceiling)
        wanted |= (high >= max(floor, kth(low[sure], k))) & (low <= ceiling)
    near = rows[wanted]
    score = vectors[near].astype(np.int64) @ x
    found = []
    for p in ceilings:
        inside = np.flatnonzero((100 * score >= low_share * p) & (100 * score <= high_share * p))
        top = inside[best(ids[near[inside]], score[inside], k)]
        found.append((p, near[top], score[top]))
    return found, len(near)


def narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    top = int(np.abs(x).max(initial=0))
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(t).max))


def _whole(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of packed integers, whose type follows from their size."""
    raw = column.combine_chunks().to_pylist()
    out = np.empty((len(raw), dims), np.int64)
    for i, r in enumerate(raw):
        out[i] = np.frombuffer(r, f"i{len(r) // dims}")
    return narrow(out)


def _grid(table: DataFrame, own: str, other: str, parts: int, others: int, key: Column) -> DataFrame:
    """``table`` in ``parts`` blocks, once for each of the other side's blocks."""
    return table.withColumn(own, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
    )


def coded(rows: DataFrame, dims: int) -> DataFrame:
    """vec_id, label, x (packed integers), codes, scalars."""
    turn = rotation(dims)

    def run(batches):
        for batch in batches:
            x = integers(matrix(batch.column(2), dims), dims)
            codes, scalars = encode(x, turn)
            binary = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([narrow(r).tobytes() for r in x], pa.binary()),
                 binary(codes), binary(scalars)], ["vec_id", "label", "x", "codes", "scalars"],
            )

    return rows.select("vec_id", "label", "embedding").mapInArrow(
        run, "vec_id long, label long, x binary, codes binary, scalars binary"
    )


class _Block:
    """The rows of a block, unpacked."""

    def __init__(self, table: pa.Table, dims: int):
        self.ids, self.labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
        self.vectors = _whole(table.column("x"), dims)
        raw = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        self.codes = raw("codes", np.uint64).reshape(len(self.ids), LEVELS, -1)
        self.scalars = raw("scalars", np.float64).reshape(len(self.ids), -1)

    @property
    def data(self):
        return self.ids, self.vectors, self.codes, self.scalars


_FOUND = pa.schema([("anchor_id", pa.int64()), ("ceiling", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()),
                    ("scored", pa.int64())])


def _meet(rows: DataFrame, anchors: DataFrame, dims: int, work) -> DataFrame:
    """anchor_id, ceiling, vec_id, score, scored of every pair of blocks, by ``work``."""
    turn = rotation(dims)
    n, asked = rows.count(), anchors.count()
    row_parts, anchor_parts = (max(1, -(-count * dims // size)) for count, size in ((n, BLOCK), (asked, ASK)))
    left = _grid(rows, "rb", "ab", row_parts, anchor_parts, F.struct("vec_id", "x", "label"))
    right = _grid(anchors, "ab", "rb", anchor_parts, row_parts, F.col("vec_id"))

    def run(own: pa.Table, asking: pa.Table) -> pa.Table:
        if not len(own) or not len(asking):
            return _FOUND.empty_table()
        block, out = _Block(own, dims), []
        xs = _whole(asking.column("x"), dims).astype(np.int64)
        ceilings = asking.column("ceilings").to_pylist()
        for x, anchor_id, label, tops in zip(xs, asking.column("vec_id").to_pylist(), asking.column("label").to_pylist(), ceilings):
            out.append(work(block, Anchor(x, turn), x, anchor_id, label, tops))
        return pa.concat_tables([t for t in out if len(t)] or [_FOUND.empty_table()])

    kind = "anchor_id long, ceiling long, vec_id long, score long, scored long"
    return left.groupBy("rb", "ab").cogroup(right.groupBy("rb", "ab")).applyInArrow(run, kind)


def _rows(anchor_id: int, ceiling: int | None, ids: np.ndarray, score: np.ndarray, scored: int) -> pa.Table:
    n = len(ids)
    return pa.table([
        pa.array([anchor_id] * n, pa.int64()), pa.array([ceiling] * n, pa.int64()), pa.array(ids, pa.int64()),
        pa.array(score, pa.int64()), pa.array([scored] * n, pa.int64()),
    ], schema=_FOUND)


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame, asks: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low_share: int = LOW_SHARE, high_share: int = HIGH_SHARE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, label (an integer), embedding; ``asks`` tells the anchors among them.
    A positive's window is low_share * positive <= 100 * negative <= high_share * positive.
    """
    spark = rows.sparkSession
    prepare(spark)
    good = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding",
        F.coalesce(asks, F.lit(False)).alias("asks"),
    ).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")))
    dims = common_length(good)
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if dims is None:
        return spark.createDataFrame([], empty)
    good = good.where(F.size("embedding") == dims)
    table = materialize(coded(good, dims), "codes")
    asking = good.where("asks").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r"))
    asking = coded(asking.select("vec_id", "r.label", "r.embedding"), dims).select("vec_id", "label", "x")
    asking = materialize(asking, "anchors")

    def same(block: _Block, anchor: Anchor, x, anchor_id, label, _):
        rows_ = np.flatnonzero((block.labels == label) & (block.ids != anchor_id))
        if not len(rows_):
            return _FOUND.empty_table()
        place, score, scored = closest(anchor, x, anchor_id, rows_, *block.data, positives)
        return _rows(anchor_id, None, block.ids[place], score, scored)

    def other(block: _Block, anchor: Anchor, x, anchor_id, label, tops):
        rows_ = np.flatnonzero((block.labels != label) & (block.ids != anchor_id))
        if not len(rows_):
            return _FOUND.empty_table()
        found, scored = windowed(anchor, x, tops, rows_, *block.data, negatives, low_share, high_share)
        return pa.concat_tables([_rows(anchor_id, p, block.ids[place], score, scored) for p, place, score in found])

    found = _meet(table, asking.withColumn("ceilings", F.array().cast("array<long>")), dims, same)
    pairs = materialize(_ranked(found, ["anchor_id"], positives).select(
        "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    ), "positives")
    # At most ``positives`` scores an anchor.
    tops = pairs.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("positive_score").alias("ceilings"))
    found = _meet(table, asking.join(tops, "vec_id"), dims, other)
    hard = _ranked(found, ["anchor_id", "ceiling"], negatives).select(
        "anchor_id", F.col("ceiling").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"),
        F.col("score").alias("negative_score"),
    )
    return pairs.join(hard, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
