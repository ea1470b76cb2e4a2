"""Mixing sources to target weights by a time-varying curriculum.

Targets: the sources, in code-point order with null last, get weights that
repeat ``WEIGHTS`` and share all words; a target stops at ``CAP`` times its
source's words and the excess goes to the others by weight. That is the level
``x`` with target = min(CAP * size, x * weight), found by a few aggregates over
the source table.

Curriculum: a source's share of the mix changes over the training time t in
0..1 with the density 1 + a(2t - 1), where ``a`` repeats ``TILTS``. Its
integral t + a(t*t - t) is the cumulative demand; a document whose words lie at
share u of its source's target is read at the t where the integral is u. The
documents are then range-sorted by that position.

Within a source the documents follow each other in the order of a hash of the
id, again and again until the target is reached. A pass of a document counts
when the middle of its words lies below the target, so whole documents are
taken, the sum misses the target by half a document at most, and no document
exceeds ``CAP`` passes. The running sums are taken within hash buckets, with
the buckets' totals before them, so a source with a third of all rows is spread
over ``BUCKETS`` tasks.

Defined results: a null or empty text has size 0 and is never taken; null is a
source of its own; a null doc_id is ordered by its hash like any other;
repeated rows are separate documents, ordered by text. An empty table gives an
empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import packed
from parlance.session import materialize

WEIGHTS = (5, 2, 1)
TILTS = (0.0, 0.6, -0.6)
CAP = 3
BUCKETS = 256


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """place, source_size, weight, tilt, target: one row per source of ``place, source_size``.

    The source table is the corpus's metadata, one short row per source.
    """
    turn = F.row_number().over(Window.orderBy("place")) - 1
    pick = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), F.pmod(turn, F.lit(len(values))))
    table = materialize(sizes.withColumns({"weight": pick(weights), "tilt": pick(TILTS)}), "sources")
    total = table.agg(F.sum("source_size").alias("n")).head()["n"] or 0
    most, level = F.col("source_size") * float(cap), None
    while True:
        # Each round fixes the sources that are above their cap; the rest share anew.
        full = F.lit(False) if level is None else most <= F.col("weight") * level
        sums = table.agg(
            F.sum(F.when(full, most).otherwise(0.0)).alias("fixed"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).head()
        if not sums["open"]:
            break
        after = (total - sums["fixed"]) / sums["open"]
        if level is not None and after <= level:
            break
        level = after
    return table.withColumn("target", F.least(most, F.col("weight") * (level or 0.0)))


def _keys(docs: DataFrame) -> list[Column]:
    """place (the source in its order, never null), doc_id, size, rank, tie."""
    source = docs["source"]
    return [
        F.concat(F.when(source.isNull(), "1").otherwise("0"), F.coalesce(source, F.lit(""))).alias("place"),
        docs["doc_id"].alias("doc_id"), words(docs["text"]).alias("size"),
        F.md5(F.coalesce(docs["doc_id"].cast("string"), F.lit(""))).alias("rank"),
        F.md5(F.coalesce(docs["text"], F.lit(""))).alias("tie"),
    ]


def mix(rows: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``rows`` (with the columns of ``_keys``) and source_size, target, taken, copies, positions (one per pass)."""
    rows = rows.withColumn("bucket", F.conv(F.substring("rank", 1, 2), 16, 10).cast("int"))
    buckets = materialize(rows.groupBy("place", "bucket").agg(F.sum("size").alias("words")), "buckets")
    plan = targets(buckets.groupBy("place").agg(F.sum("words").alias("source_size")), weights, cap)
    before = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    starts = materialize(starts.join(plan, "place"), "starts")
    inside = Window.partitionBy("place", "bucket").orderBy("rank", "doc_id", "tie")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    run = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["place", "bucket"])
    source_size, tilt = F.nullif(F.col("source_size"), F.lit(0)), F.col("tilt")
    middle = F.col("base") + F.col("within") + F.col("size") / 2.0
    passes = F.ceil((F.col("target") - middle) / source_size)
    run = run.withColumn("copies", F.when(F.col("size") > 0, F.greatest(passes, F.lit(0))).otherwise(0).cast("long"))

    def position(e: Column) -> Column:
        """The time at which the integral of the source's schedule is the pass's share of the target."""
        u = (middle + e * F.col("source_size")) / F.nullif(F.col("target"), F.lit(0.0))
        root = F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * u)
        return F.when(tilt == 0, u).otherwise((tilt - 1 + root) / F.nullif(2 * tilt, F.lit(0.0)))

    passes_made = F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    return run.withColumns({
        "taken": F.col("size") * F.col("copies"),
        "positions": F.coalesce(F.transform(passes_made, position), F.expr("cast(array() as array<double>)")),
    })


def mixture(docs: DataFrame) -> DataFrame:
    """Every document with what the mix takes of it, range-sorted by its first training position."""
    out = mix(materialize(docs.select(*_keys(docs)), "sizes"))
    out = out.select(
        "doc_id", "size", "source_size", "target", "taken", F.round(F.get("positions", F.lit(0)), 6).alias("position")
    )
    order = [F.col("position").asc_nulls_last(), F.col("doc_id")]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)


def curriculum(docs: DataFrame) -> DataFrame:
    """The training sequence: the taken documents, one row per pass, range-sorted by position; all columns stay."""
    passes = mix(packed(docs, *_keys(docs))).select("_row", "doc_id", F.explode("positions").alias("position"))
    order = [F.col("position"), F.col("doc_id")]
    return passes.repartitionByRange(*order).sortWithinPartitions(*order).select("_row.*")
