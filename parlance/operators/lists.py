"""Jobs over short lists held as one array value per row.

A response lists at most ``MAX_LIST`` items, so filtering, pairing and zipping
happen inside the row: no join, no shuffle, and no group to be skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.rouge import rouge_l_expr
from parlance.functions.text import word_tokens

# Most items asked of the model at once, and the ROUGE-L from
# which an item repeats an earlier one.
MAX_LIST = 20
REPEAT_THRESHOLD = 0.5


def check_count(n: int | None, name: str = "n") -> int:
    if n is None:
        raise ValueError(f"{name} is required")
    if not 0 <= n <= MAX_LIST:
        raise ValueError(f"{name} must be between 0 and {MAX_LIST}, got {n}")
    return n


def truncate(items: Column, n: int) -> Column:
    return F.slice(items, 1, check_count(n)) if n else F.slice(items, 1, 0)


def drop_repeated(items: Column, threshold: float = REPEAT_THRESHOLD) -> Column:
    """Keep an item unless its ROUGE-L with an item kept earlier reaches the threshold."""
    tokens = F.transform(items, lambda t: F.struct(t.alias("item"), word_tokens(t).alias("tokens")))
    nothing = F.filter(tokens, lambda _: F.lit(False))

    def step(kept: Column, item: Column) -> Column:
        new = F.forall(kept, lambda k: rouge_l_expr(k["tokens"], item["tokens"]) < threshold)
        return F.when(new, F.concat(kept, F.array(item))).otherwise(kept)

    return F.transform(F.aggregate(tokens, nothing, step), lambda k: k["item"])


def pair_structs(items: Column) -> Column:
    """Every unordered pair of a short list, first positions first."""
    return F.flatten(
        F.transform(
            items,
            lambda left, i: F.transform(
                F.slice(items, i + 2, F.greatest(F.size(items) - i - 1, F.lit(0))),
                lambda right, j: F.struct(
                    i.cast("int").alias("pos_1"),
                    (i + j + 1).cast("int").alias("pos_2"),
                    left.alias("persona_1"),
                    right.alias("persona_2"),
                ),
            ),
        )
    )


def explode_pairs(df: DataFrame, items: str) -> DataFrame:
    """One row per unordered pair of the list column ``items``."""
    return df.select(
        *[c for c in df.columns if c != items], F.explode(pair_structs(F.col(items))).alias("_p")
    ).select(*[c for c in df.columns if c != items], "_p.*")


def gather_lists(df: DataFrame, keys: list[str], pos: list[str], item: str, out: str) -> DataFrame:
    """Lists per key in position order.

    For keys whose number of items is bounded, such as the personas of one
    sub-topic; larger groups belong to ``operators.dedup``.
    """
    entry = F.struct(*pos, item)
    return df.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e[item]).alias(out)
    )


def zip_answers(df: DataFrame, left: str, right: str, keep: list[str]) -> DataFrame:
    """Rows of two answer lists of equal length, matched by position.

    Rows with a missing list or lists of different length are dropped.
    """
    usable = df.where(
        F.col(left).isNotNull()
        & F.col(right).isNotNull()
        & (F.size(left) == F.size(right))
    )
    pairs = F.posexplode(F.arrays_zip(F.col(left).alias("l"), F.col(right).alias("r")))
    return usable.select(*keep, pairs.alias("pos", "_z")).select(
        *keep, "pos", F.col("_z.l").alias(left), F.col("_z.r").alias(right)
    )
