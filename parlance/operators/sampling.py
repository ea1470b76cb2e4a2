"""First rows per group, seeded samples, global row positions.

None of them sorts a whole table or brings one into a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.session import lookup_join, materialize

# Digits of a hash, and those that one pass of a radix search counts by: at most 16 ** DIGITS rows reach the driver.
HASH_DIGITS, DIGITS = 32, 3
SALTS = 64


def first_k(df: DataFrame, keys: list[str], order: list[str], k: int, pos: str = "pos") -> DataFrame:
    """First ``k`` rows of each group, numbered from 0.

    Each group is limited by salt and then as a whole, and both rank filters
    become group limits below their shuffle. However many tasks hold rows of a
    hot group, the one that numbers it gets ``k`` rows of each salt.
    """
    salt = F.pmod(F.xxhash64(*order), F.lit(SALTS))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    some = df.withColumn("_salt", salt).withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= k)
    ranked = some.drop("_salt", "_rank").withColumn(pos, F.row_number().over(whole)).where(F.col(pos) <= k)
    return ranked.withColumn(pos, F.col(pos) - 1)


def hash_key(ids: list[str], seed: int | str) -> Column:
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]))


def sample_few(df: DataFrame, ids: list[str], k: int, seed: int | str) -> DataFrame:
    """``k`` rows without replacement for a small ``k`` (worked examples)."""
    return df.orderBy(hash_key(ids, seed), *ids).limit(k)


def cutoff(hashes: DataFrame, n: int) -> tuple[str, int]:
    """Prefix of the n-th smallest of the column _h, and how many rows with that prefix belong to the first ``n``.

    A radix search: each pass counts the rows by the next ``DIGITS`` digits
    within the prefix found so far, so that a few thousand counts reach the
    driver. It ends as soon as a prefix is taken whole, or with the hash.
    """
    prefix, rest = "", n
    while len(prefix) < HASH_DIGITS:
        bucket = F.substring("_h", len(prefix) + 1, DIGITS)
        inside = hashes.where(F.col("_h").startswith(prefix)) if prefix else hashes
        for row in sorted(inside.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()):
            if row["n"] >= rest:
                break
            rest -= row["n"]
        prefix += row["b"]
        if row["n"] == rest:
            break
    return prefix, rest


def sample_exact(df: DataFrame, ids: list[str], n: int, seed: int | str) -> DataFrame:
    """Exactly ``n`` rows without replacement, for ``n`` of any size.

    Rows are ranked by a seeded hash of their ``ids``. The search for the n-th
    smallest hash reads a table of hashes alone; the sample is then a filter on
    the rows. Only among rows that repeat the ids of the last one is a choice
    left, which a limit makes.
    """
    keyed = df.withColumn("_h", hash_key(ids, seed))
    hashes = materialize(keyed.select("_h"), "hashes")
    total = hashes.count()
    if total < n:
        raise ValueError(f"sample of {n} from {total} rows")
    if n <= 0:
        return df.limit(0)
    prefix, rest = cutoff(hashes, n)
    head = F.substring("_h", 1, len(prefix))
    if len(prefix) < HASH_DIGITS or hashes.where(F.col("_h") == prefix).count() == rest:
        return keyed.where(head <= prefix).drop("_h")
    last = keyed.where(F.col("_h") == prefix).limit(rest)
    return keyed.where(F.col("_h") < prefix).unionByName(last).drop("_h")


def size_matched(df: DataFrame, ids: list[str], other: DataFrame, seed: int | str) -> DataFrame:
    """As many rows of ``df`` as ``other`` has; an error when there are fewer."""
    return sample_exact(df, ids, other.count(), seed)


def with_position(df: DataFrame, order: str | list[str], pos: str = "pos", parts: int | None = None) -> DataFrame:
    """Global row number from 0 in the order of the columns, which may be of any type and repeat.

    A distributed prefix sum: the rows are range-partitioned, sorted and
    numbered within their partition, and written, so that the numbers stay; the
    partitions' counts, one small row each, summed in order give the offsets. No
    task sees more than one range, and no bounds go through the driver.
    """
    spark = df.sparkSession
    order = [order] if isinstance(order, str) else order
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    # The id holds the partition above bit 33 and the row's place in it below.
    rows = materialize(ranged.withColumn("_id", number), "ranges").withColumns({
        "_part": F.shiftright("_id", 33).cast("int"), "_place": F.col("_id").bitwiseAND((1 << 33) - 1),
    })
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # A row per partition.
    joined = lookup_join(rows, materialize(starts, "offsets"), ["_part"])
    return joined.withColumn(pos, F.col("_start") + F.col("_place")).drop("_id", "_part", "_place", "_start")


def chunked_mean(df: DataFrame, order: str, value: str, n: int) -> DataFrame:
    """Sum of every ``n`` values in order divided by ``n``, also for a short last chunk."""
    chunk = F.floor(F.col("_pos") / n).cast("long")
    return (
        with_position(df.select(order, value), order, "_pos")
        .groupBy(chunk.alias("chunk"))
        .agg((F.sum(value) / F.lit(n)).alias("mean"))
    )
