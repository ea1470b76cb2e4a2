"""Greedy keep-first filter over groups of any size.

Same result as ``lists.drop_repeated``: in position order an item is kept
unless its ROUGE-L with an item kept earlier reaches the threshold.

* Items become rows of 64-bit numbers: an id, the hash of the group, the
  position, and the token ids, written once. Everything after works on ids;
  token arrays are fetched for the pairs that must be compared, and only then.
* Items with equal tokens are decided by their first copy and leave at once,
  by an aggregation on digests that combines before the shuffle.
* A pair can only reach the threshold when it shares a token among the rarest
  ones of both sides (prefix filter; Chaudhuri et al. 2006, Xiao et al. 2008).
  Rarity is exact: tokens are counted over all items of the large groups, and
  (count, token) is their order. Only items that meet in the posting list of
  such a token are compared.
* The rest goes in rounds (Blelloch, Fineman, Shun 2012). A round looks at the
  first ``window`` items of each posting list only, decides those without an
  undecided similar predecessor, and drops what is similar to a newly kept
  item. Near copies leave with their first one after one comparison each, so a
  large cluster costs its size, not its square. The window doubles per round.
  A leader that many items follow is spread by a salt.
* A group that has, or is left with, at most ``LOCAL_ITEMS`` undecided items is
  walked by one task in one go; the rounds serve the larger ones.
* Groups of long texts (more than ``LONG_ITEM`` tokens an item) have no postings:
  those would be larger than the texts, and most of them long. They are cut by
  position into blocks of ``BLOCK_ITEMS``. A round walks one block of every
  group, and the later blocks leave out what is similar to an item it keeps.
  Both search by ``near.Shelf``. Later blocks are read as 16 bits a token, which
  can only call too much similar; its pairs are compared by their ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions import near
from parlance.functions.rouge import Prepared
from parlance.functions.text import word_text
from parlance.functions.tokens import numbered, token_ids
from parlance.operators.diversity import laid_out
from parlance.operators.lists import REPEAT_THRESHOLD
from parlance.session import lookup_join, materialize

FIRST_WINDOW = 64
# Undecided items, and their tokens, that one task may walk through.
LOCAL_ITEMS = 512
LOCAL_TOKENS = 1_000_000
# Mean tokens of an item beyond which a large group goes by blocks, and the items and tokens of a block.
LONG_ITEM = 64
BLOCK_ITEMS, BLOCK_TOKENS = 8_192, 8_000_000
# Tasks that search one later block.
BLOCK_PARTS = 4
# Ids, a number each, that are sent to every executor rather than token arrays shuffled.
SENT_IDS = 300_000
# Postings of one token that one task may join.
LIST_ROWS = 50_000
# Pairs of one leader that are compared with one copy of its token array.
LEADER_PAIRS = 1_000


@F.pandas_udf(T.ArrayType(T.LongType()))
def _marks(ids: pd.Series) -> pd.Series:
    return pd.Series([numbered(np.asarray(x, np.int64)) for x in ids], dtype="object")


@F.pandas_udf(T.BooleanType())
def _pair(a: pd.Series, b: pd.Series, a_id: pd.Series, threshold: pd.Series) -> pd.Series:
    """Whether two token arrays are similar. Rows of equal ``a_id`` in a row share its preparation."""
    last, prepared, out = None, None, []
    for x, y, key, t in zip(a, b, a_id, threshold):
        if key != last:
            last, prepared = key, Prepared(x.tolist())
        out.append(prepared.reaches(Prepared(y.tolist()), t))
    return pd.Series(out, dtype="bool")


def _postings(items: DataFrame, threshold: float) -> DataFrame:
    """_id, _group, _pos, _n, _token, _early: the rarest tokens of every item.

    Repeated tokens are numbered. With n tokens, an item needs an overlap of
    at least n*t/(2-t) with any partner, and of n*t with one that is not
    shorter; ``_early`` marks the shorter prefix that suffices then.
    """
    marked = items.select("_id", "_group", "_pos", _marks("_ids").alias("_marks"))
    marked = materialize(marked, "marks")
    spread = marked.select("_id", F.explode("_marks").alias("_token"))
    counts = materialize(spread.groupBy("_token").agg(F.count("*").alias("_rows")), "rarity")
    # A frequent token's rows are spread by their item.
    counted = lookup_join(spread, counts, ["_token"], "inner", F.col("_id"))
    ranked = counted.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("_rows", "_token"))).alias("_ranked"))
    n = F.size("_ranked")
    # The small slack keeps rounding from shortening a prefix.
    needed = lambda share: (n - F.ceil(n * share - 1e-9) + 1).cast("int")
    prefix = F.slice("_ranked", F.lit(1), F.least(needed(threshold / (2 - threshold)), n))
    rows = ranked.select("_id", n.alias("_n"), needed(threshold).alias("_short"), F.posexplode(prefix).alias("_k", "_r"))
    return marked.select("_id", "_group", "_pos").join(rows, "_id").select(
        "_id", "_group", "_pos", "_n", F.col("_r._token").alias("_token"), (F.col("_k") < F.col("_short")).alias("_early")
    )


def _candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Distinct (a, b) of two posting tables that share a token and may be similar."""
    a = left.select("_group", "_token", *[F.col(c).alias(f"a{c}") for c in ("_id", "_pos", "_n", "_early")])
    b = right.select("_group", "_token", *[F.col(c).alias(f"b{c}") for c in ("_id", "_pos", "_n", "_early")])
    ratio = (2 - threshold) / threshold
    near = (F.col("a_n") <= F.col("b_n") * ratio) & (F.col("b_n") <= F.col("a_n") * ratio)
    # The one that is not longer needs only its short prefix to meet.
    meet = F.when(F.col("a_n") <= F.col("b_n"), F.col("a_early")).otherwise(F.col("b_early"))
    keys = ["_group", "_token"]
    long_lists = (
        b.groupBy(*keys).count().where(F.col("count") > LIST_ROWS)
        .select(*keys, F.ceil(F.col("count") / LIST_ROWS).cast("int").alias("_parts"))
    )
    long_lists = materialize(long_lists, "lists")
    if not long_lists.isEmpty():
        # Cut the long lists and give every cut the (at most window) a-rows.
        a, b = (
            lookup_join(side, long_lists, keys, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
            for side in (a, b)
        )
        a = a.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
        b = b.withColumn("_part", F.pmod(F.xxhash64("b_id"), F.col("_parts")).cast("int")).drop("_parts")
        keys.append("_part")
    # Few bytes meet in many combinations here: a set number of tasks, too.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        a.repartition(tasks, *keys).join(b.repartition(tasks, *keys), keys)
        .where((F.col("a_pos") < F.col("b_pos")) & near & meet)
        .select("a_id", "b_id")
        .distinct()
    )


def _similar(pairs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """The pairs that reach the threshold.

    Pairs are few bytes and much work, so their number of tasks is set rather
    than left to size-based coalescing. Token arrays are shuffled and never
    broadcast, however few leaders there are: a leader's array is repeated once
    per ``LEADER_PAIRS`` of its pairs, so one with many partners is spread.
    """
    spark = pairs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = materialize(pairs, "pairs")
    parts = F.ceil(F.count("*") / LEADER_PAIRS).cast("int")
    leaders = materialize(pairs.groupBy("a_id").agg(parts.alias("_parts")), "leaders")
    cut = lookup_join(pairs, leaders.where("_parts > 1"), ["a_id"], "left", F.col("b_id"))
    part = F.pmod(F.xxhash64("b_id"), F.coalesce("_parts", F.lit(1))).cast("int")
    cut = cut.withColumn("_part", part).drop("_parts")
    b = items.select(F.col("_id").alias("b_id"), F.col("_ids").alias("_b"))
    a = items.select(F.col("_id").alias("a_id"), F.col("_ids").alias("_a")).join(leaders, "a_id")
    a = a.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    keys = ["a_id", "_part"]
    joined = cut.join(b.hint("shuffle_merge"), "b_id").repartition(tasks, *keys).join(
        a.repartition(tasks, *keys).hint("shuffle_merge"), keys
    )
    scored = joined.sortWithinPartitions("a_id")
    return scored.where(_pair("_a", "_b", "a_id", F.lit(threshold))).select("a_id", "b_id")


def _round(
    postings: DataFrame, items: DataFrame, threshold: float, window: int
) -> tuple[DataFrame, DataFrame]:
    """Newly kept _id, and the postings of what is still undecided."""
    lists = Window.partitionBy("_group", "_token").orderBy("_pos", "_id")
    ranked = postings.withColumn("_rank", F.row_number().over(lists)).where(F.col("_rank") <= window)
    # An item whose every posting is in a window sees all its predecessors.
    sizes = postings.groupBy("_id").agg(F.count("*").alias("_all"))
    seen = ranked.groupBy("_id").agg(F.count("*").alias("_seen"))
    front = seen.join(sizes, "_id").where(F.col("_seen") == F.col("_all")).select("_id", F.lit(True).alias("_front"))
    head = materialize(ranked.drop("_rank").join(front, "_id", "left"), "head")
    ready = head.where("_front")
    edges = _similar(_candidates(head, ready, threshold), items, threshold)
    blocked = edges.select(F.col("b_id").alias("_id")).distinct()
    kept = materialize(ready.select("_id").distinct().join(blocked, "_id", "left_anti"), "kept")
    leaders = postings.join(kept, "_id", "left_semi")
    followers = postings.join(kept, "_id", "left_anti")
    dropped = _similar(_candidates(leaders, followers, threshold), items, threshold)
    gone = dropped.select(F.col("b_id").alias("_id")).distinct()
    return kept, materialize(followers.join(gone, "_id", "left_anti"), "postings")


def _walk(items: DataFrame, threshold: float) -> DataFrame:
    """_id of the items kept in groups of bounded size."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[Prepared] = []
        ids = []
        for key, tokens in pdf.sort_values("_pos")[["_id", "_ids"]].itertuples(index=False):
            item = Prepared(tokens.tolist())
            if not any(k.reaches(item, threshold) for k in kept):
                kept.append(item)
                ids.append(key)
        return pd.DataFrame({"_id": pd.Series(ids, dtype="int64")})

    return items.groupBy("_group").applyInPandas(walk, "_id long")


@F.pandas_udf(T.BinaryType())
def _codes(ids: pd.Series) -> pd.Series:
    return pd.Series([near.codes(np.asarray(x, np.int64)).tobytes() for x in ids], dtype="object")


def _walk_block(items: DataFrame, threshold: float) -> DataFrame:
    """_id of the items kept in groups of at most a block."""

    def walk(own: pa.Table) -> pa.Table:
        shelf, kept = near.Shelf(threshold), []
        own = own.sort_by("_pos").combine_chunks()
        keys, lists_ = own.column("_id").to_numpy(), own.column("_ids")
        for i, key in enumerate(keys.tolist()):
            item = near.Entry(np.asarray(lists_[i].values, np.int64))
            if next(shelf.similar(item), None) is None:
                shelf.add(item)
                kept.append(key)
        return pa.table({"_id": pa.array(kept, pa.int64())})

    return items.groupBy("_group").applyInArrow(walk, "_id long")


def _later(leaders: DataFrame, followers: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a_id, b_id) of a leader and a follower that their codes call similar.

    A group's leaders go once to each of ``BLOCK_PARTS`` tasks of each of its later blocks.
    """
    schema = pa.schema([("a_id", pa.int64()), ("b_id", pa.int64())])

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        read = lambda x: near.Entry(np.frombuffer(x.as_py(), np.uint16).astype(np.int64))
        shelf, left, right = near.Shelf(threshold), [], []
        names = a.column("_id").to_numpy()
        if len(b):
            for x in a.column("_codes"):
                shelf.add(read(x))
        for key, x in zip(b.column("_id").to_pylist(), b.column("_codes")):
            found = [names[i] for i in shelf.similar(read(x))]
            left += found
            right += [key] * len(found)
        return pa.table([pa.array(left, pa.int64()), pa.array(right, pa.int64())], schema=schema)

    tasks = int(leaders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = lambda lo, hi: F.explode(F.sequence(lo, hi))
    a = leaders.where("_block < _blocks - 1").withColumn("_to", every(F.col("_block") + 1, F.col("_blocks") - 1))
    a = a.withColumn("_part", every(F.lit(0), F.lit(BLOCK_PARTS - 1)))
    b = followers.withColumn("_to", F.col("_block")).withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(BLOCK_PARTS)).cast("int"))
    keys = ["_group", "_to", "_part"]
    # Columns of their own on both sides: they stem from one table.
    a, b = (x.select(*[F.col(c).alias(c) for c in (*keys, "_id", "_codes")]).repartition(tasks, *keys) for x in (a, b))
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(search, "a_id long, b_id long")


def _by_blocks(items: DataFrame, sized: DataFrame, threshold: float) -> list[DataFrame]:
    """_id of the items kept in the groups of ``sized`` (_id, _group, _size), however large."""
    own = lambda ids, of=items: lookup_join(
        of, ids.select("_id"), ["_id"], "left_semi", F.col("_id"), SENT_IDS
    )
    mean = sized.agg(F.avg("_size")).head()[0]
    block = max(1, min(BLOCK_ITEMS, int(BLOCK_TOKENS / max(mean, 1))))
    placed = items.select("_id", "_group", "_pos").join(sized.select("_id"), "_id", "left_semi")
    placed = placed.withColumnRenamed("_id", "_item")
    placed = materialize(laid_out(placed, "_group", "_pos", block), "placed")
    placed = placed.select(F.col("_item").alias("_id"), "_block", "_blocks")
    blocks = placed.agg(F.max("_blocks")).head()[0]
    later = placed.where("_blocks > 1")
    if blocks > 1:
        codes = items.select("_id", "_group", _codes("_ids").alias("_codes")).join(later, "_id")
        codes = materialize(codes, "codes")
    kept_parts, gone = [], None
    for k in range(blocks):
        undecided = placed.where(F.col("_block") == k)
        if gone is not None:
            undecided = lookup_join(undecided, gone, ["_id"], "left_anti", F.col("_id"))
        kept = materialize(_walk_block(own(materialize(undecided, "undecided")), threshold), "kept")
        kept_parts.append(kept)
        if k == blocks - 1:
            break
        followers = codes.where(F.col("_block") > k)
        if gone is not None:
            followers = lookup_join(followers, gone, ["_id"], "left_anti", F.col("_id"))
        leaders = own(kept, codes.where(F.col("_block") == k))
        pairs = materialize(_later(leaders, followers, threshold), "pairs")
        met = pairs.select(F.col("a_id").alias("_id")).union(pairs.select("b_id")).distinct()
        similar = _similar(pairs, own(materialize(met, "met")), threshold)
        dropped = materialize(similar.select(F.col("b_id").alias("_id")).distinct(), "gone")
        gone = dropped if gone is None else gone.unionByName(dropped)
    return kept_parts


def _split_by_size(left: DataFrame, local_items: int) -> tuple[DataFrame, DataFrame | None]:
    """Undecided items (_id, _group, _size) of the groups one task may walk, and those of larger groups if any."""
    sizes = left.groupBy("_group").agg(F.count("*").alias("_items"), F.sum("_size").alias("_tokens"))
    over = (F.col("_items") > local_items) | (F.col("_tokens") > LOCAL_TOKENS)
    large = materialize(sizes.where(over).select("_group"), "large")
    if large.isEmpty():
        return left, None
    spread = F.col("_id")
    return (
        lookup_join(left, large, ["_group"], "left_anti", spread),
        materialize(lookup_join(left, large, ["_group"], "left_semi", spread), "left"),
    )


def _split_by_length(left: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Items (_id, _group, _size) of the groups that go by blocks, and of those that go by postings, if any."""
    sizes = left.groupBy("_group").agg(F.avg("_size").alias("_mean"))
    long = materialize(sizes.where(F.col("_mean") > LONG_ITEM).select("_group"), "long")
    if long.isEmpty():
        return None, left
    spread = F.col("_id")
    rest = materialize(lookup_join(left, long, ["_group"], "left_anti", spread), "left")
    return (
        materialize(lookup_join(left, long, ["_group"], "left_semi", spread), "left"),
        None if rest.isEmpty() else rest,
    )


def group_hash(group: Column) -> Column:
    """Hash of a group's value; a missing group is a group of its own."""
    return F.xxhash64(F.to_json(F.struct(group.alias("g"))))


def firsts(words: DataFrame) -> DataFrame:
    """_group, _digest, _pos of the first of equal items: numbers and digests only, combined before the shuffle."""
    return words.where(F.col("_words") != "").groupBy("_group", "_digest").agg(F.min("_pos").alias("_pos"))


def greedy_filter(
    df: DataFrame,
    group: str,
    pos: str,
    item: str,
    threshold: float = REPEAT_THRESHOLD,
    window: int = FIRST_WINDOW,
    local_items: int = LOCAL_ITEMS,
) -> DataFrame:
    """Rows of ``df`` that the filter keeps. ``pos`` is unique within a group.

    A null item counts as one without tokens: similar to nothing, it stays.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    words = df.select(
        group_hash(F.col(group)).alias("_group"), F.col(pos).cast("long").alias("_pos"),
        F.coalesce(word_text(F.col(item)), F.lit("")).alias("_words"),
    ).withColumn("_digest", F.md5("_words"))
    # Items without tokens score 0 with everything.
    silent = words.where(F.col("_words") == "").select("_group", "_pos")
    first = materialize(firsts(words).select("_group", "_pos"), "firsts")
    rows = words.join(first, ["_group", "_pos"], "left_semi")
    items = materialize(rows.select(
        F.monotonically_increasing_id().alias("_id"), "_group", "_pos", token_ids(F.col("_words")).alias("_ids")
    ), "items")
    small, left = _split_by_size(items.select("_id", "_group", F.size("_ids").alias("_size")), local_items)
    # Token arrays are shuffled for no join with a few numbers.
    own = lambda ids: lookup_join(
        items, ids.select("_id"), ["_id"], "left_semi", F.col("_id"), SENT_IDS
    )
    kept_parts = [materialize(_walk(own(small) if left is not None else items, threshold), "kept")]
    if left is not None:
        long, left = _split_by_length(left)
        if long is not None:
            kept_parts += _by_blocks(items, long, threshold)
    if left is not None:
        postings = materialize(_postings(own(left), threshold), "postings")
    while left is not None:
        kept, postings = _round(postings, items, threshold, window)
        kept_parts.append(kept)
        window *= 2
        left = left.join(postings.select("_id").distinct(), "_id", "left_semi")
        small, left = _split_by_size(materialize(left, "left"), local_items)
        kept_parts.append(materialize(_walk(own(small), threshold), "kept"))
        if left is not None:
            postings = postings.join(left.select("_id"), "_id", "left_semi")

    kept = kept_parts[0]
    for part in kept_parts[1:]:
        kept = kept.unionByName(part)
    decided = items.select("_id", "_group", "_pos").join(kept, "_id", "left_semi").select("_group", "_pos")
    survivors = decided.unionByName(silent)
    return (
        df.withColumn("_group", group_hash(F.col(group)))
        .withColumn("_pos", F.col(pos).cast("long"))
        .join(survivors, ["_group", "_pos"], "left_semi")
        .drop("_group", "_pos")
    )
