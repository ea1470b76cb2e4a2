"""SimHash near-dedup by a binary-trie self-join.

A text's fingerprint has a bit set where more than half of its shingles' XXH64
values have it. The distinct fingerprints form a binary trie. Pairs of nodes
are walked together from the root; a pair whose prefixes differ in more bits
than the budget is dropped with everything below it. The top of the trie is
walked as a table of node pairs, two bits a round, until both nodes hold at
most ``LEAF`` fingerprints; then each pair of subtries is one bounded task that
goes on bit by bit. Equal fingerprints are one class before the walk, so a
large group of copies is one leaf.

Defined results: a null or empty text has no words and fingerprint zero, which
links like any other. A null doc_id takes part and gets its class's smallest
id (null if the class has none). Repeated rows stay repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import forest, packed, prepare, components
from parlance.session import materialize

WORDS, SEED, BITS = 4, 42, 64
MAX_BITS = 4
LEAF = 16_384
STEP = 2
# Node pairs with at most this many fingerprint pairs are compared directly.
DIRECT = 64


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Unsigned fingerprint of a UTF-8 text; shingles are slices of the words joined by spaces."""
    parts = text.lower().split()  # bytes: lowers A-Z and splits at ASCII white space only
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = ends - np.array([len(p) + 1 for p in parts])
    last = max(1, len(parts) - words + 1)
    stops = ends[words - 1 :] - 1 if len(parts) >= words else ends[-1:] - 1
    counts, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, last, 1 << 15):
        to = min(last, at + (1 << 15))
        h = np.array(
            [digest(joined[i:j], SEED) for i, j in zip(starts[at:to].tolist(), stops[at:to].tolist())], np.uint64
        )
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > last)
    return int.from_bytes(bits.tobytes(), "big")


def with_fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """_row (all columns of ``docs``), fingerprint long (the bits as a signed number)."""
    prepare(docs.sparkSession)
    rows = packed(docs, F.coalesce(docs[text], F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, words) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            signed = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], ["_row", "fingerprint"])

    return rows.mapInArrow(run, T.StructType([rows.schema["_row"], T.StructField("fingerprint", T.LongType())]))


def _prefix(value: Column, depth: int | Column) -> Column:
    """The first ``depth`` bits as a number; 0 at the root."""
    if isinstance(depth, int):
        return F.shiftrightunsigned(value, BITS - depth) if depth else F.lit(0).cast("long")
    raise TypeError(depth)


class _Trie:
    """Nodes of the sorted distinct values of one subtrie, level by level."""

    def __init__(self, values: np.ndarray, depth: int):
        self.values, self.depth = values, depth
        self.start = np.zeros(1, np.int64)
        self.size = np.array([len(values)])

    def descend(self) -> tuple[np.ndarray, np.ndarray]:
        """Goes one bit down; the numbers of each node's 0-child and 1-child, or -1."""
        self.depth += 1
        key = self.values >> np.uint64(BITS - self.depth)
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(fresh)
        parent = np.searchsorted(self.start, start, "right") - 1
        bit = (key[start] & np.uint64(1)).astype(bool)
        children = []
        for side in (~bit, bit):
            child = np.full(len(self.start), -1, np.int64)
            child[parent[side]] = np.flatnonzero(side)
            children.append(child)
        self.start, self.size = start, np.diff(np.append(start, len(key)))
        return children[0], children[1]


def close_pairs(a: np.ndarray, b: np.ndarray, depth: int, differ: int, same: bool, budget: int):
    """Values (x, y) of two sorted subtries at ``depth`` that differ in at most ``budget`` bits.

    ``same``: both are one subtrie, and each pair is found once.
    """
    left = _Trie(a, depth)
    right = left if same else _Trie(b, depth)
    na, nb, diff = (np.zeros(1, np.int64) for _ in range(3))
    diff += differ
    out: list[tuple[np.ndarray, np.ndarray]] = []
    while len(na):
        product = left.size[na] * right.size[nb]
        direct = (product <= DIRECT) | (left.depth == BITS)
        da, db = na[direct], nb[direct]
        edges = np.append(0, np.cumsum(product[direct]))
        done = 0
        while done < len(da):  # pieces of about a million comparisons
            to = max(done + 1, int(np.searchsorted(edges, edges[done] + (1 << 20), "right")) - 1)
            n = product[direct][done:to]
            pair = np.repeat(np.arange(done, to), n)
            offset = np.arange(len(pair)) - np.repeat(edges[done:to] - edges[done], n)
            width = right.size[db[pair]]
            i, j = left.start[da[pair]] + offset // width, right.start[db[pair]] + offset % width
            hit = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                hit &= i < j
            out.append((a[i[hit]], b[j[hit]]))
            done = to
        na, nb, diff = na[~direct], nb[~direct], diff[~direct]
        if not len(na):
            break
        zero_a, one_a = left.descend()
        zero_b, one_b = (zero_a, one_a) if same else right.descend()
        parts = []
        for ca, cb, more in ((zero_a, zero_b, 0), (one_a, one_b, 0), (zero_a, one_b, 1), (one_a, zero_b, 1)):
            x, y, d = ca[na], cb[nb], diff + more
            good = (x >= 0) & (y >= 0) & (d <= budget)
            if same:
                good &= x <= y
            parts.append((x[good], y[good], d[good]))
        na, nb, diff = (np.concatenate(p) for p in zip(*parts))
    if not out:
        return a[:0], b[:0]
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def trie_links(values: DataFrame, budget: int = MAX_BITS, leaf: int = LEAF) -> DataFrame:
    """a, b: edges that connect the distinct longs ``fingerprint`` within ``budget`` bits.

    Each pair of subtries gives a spanning forest of its links, not all pairs.
    """
    spark = values.sparkSession
    total = values.count()
    frontier = spark.createDataFrame([(0, 0, 0, total, total)], "pa long, pb long, differ int, na long, nb long")
    tasks: list[tuple[int, DataFrame]] = []
    for depth in range(0, BITS + 1, STEP):
        large = F.greatest("na", "nb") > leaf
        whole = depth == BITS
        ready = frontier if whole else frontier.where(~large)
        tasks.append((depth, ready))
        opened = frontier.where(large)
        if whole or opened.isEmpty():
            break
        level = values.groupBy(_prefix(F.col("fingerprint"), depth + STEP).alias("node")).agg(F.count("*").alias("n"))
        level = materialize(level.select("node", "n", F.shiftrightunsigned("node", STEP).alias("parent")), "nodes")
        ca = level.select(F.col("node").alias("ca"), F.col("n").alias("na"), F.col("parent").alias("pa"))
        cb = level.select(F.col("node").alias("cb"), F.col("n").alias("nb"), F.col("parent").alias("pb"))
        apart = F.bit_count(F.col("ca").bitwiseXOR(F.col("cb")).bitwiseAND(F.lit((1 << STEP) - 1)))
        frontier = (
            opened.select("pa", "pb", "differ").join(ca, "pa").join(cb, "pb")
            .withColumn("differ", (F.col("differ") + apart).cast("int"))
            .where((F.col("differ") <= budget) & ((F.col("pa") != F.col("pb")) | (F.col("ca") <= F.col("cb"))))
            .select(F.col("ca").alias("pa"), F.col("cb").alias("pb"), "differ", "na", "nb")
        )
        frontier = materialize(frontier, "node-pairs")
    rows = None
    for depth, ready in tasks:
        if ready.isEmpty():
            continue
        # A leaf holds a bounded number of fingerprints, so they travel as one array.
        node = _prefix(F.col("fingerprint"), depth).alias("node")
        leaves = ready.select(F.explode(F.array("pa", "pb")).alias("node")).distinct()
        leaves = values.select(node, "fingerprint").join(leaves, "node", "left_semi")
        leaves = leaves.groupBy("node").agg(F.collect_list("fingerprint").alias("held"))
        leaves = materialize(leaves, "leaves")
        left = leaves.select(F.col("node").alias("pa"), F.col("held").alias("a"))
        right = leaves.select(F.col("node").alias("pb"), F.col("held").alias("b"))
        part = ready.join(left, "pa").join(right, "pb").select(F.lit(depth).alias("depth"), "pa", "pb", "differ", "a", "b")
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return spark.createDataFrame([], "a long, b long")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                depth, pa_, pb_, differ = (batch.column(c)[k].as_py() for c in range(4))
                a, b = (np.sort(batch.column(c)[k].values.to_numpy().view(np.uint64)) for c in (4, 5))
                x, y = close_pairs(a, a if pa_ == pb_ else b, depth, differ, pa_ == pb_, budget)
                low, root = forest(x.view(np.int64), y.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(root)], ["a", "b"])

    # Even tasks: a node's pairs are spread over all of them.
    return rows.repartition("depth", "pa", "pb").mapInArrow(join, "a long, b long")


def simhash_classes(marked: DataFrame, budget: int = MAX_BITS) -> DataFrame:
    """fingerprint, root (a name of the class), component_id (its smallest doc_id), from rows doc_id, fingerprint."""
    values = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    values = materialize(values, "fingerprints")
    roots = components(trie_links(values.select("fingerprint"), budget)).withColumnsRenamed(
        {"id": "fingerprint", "component": "root"}
    )
    rooted = values.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    rooted = materialize(rooted, "roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return materialize(rooted.join(least, "root").select("fingerprint", "root", "component_id"), "classes")


def near_copies(docs: DataFrame, words: int = WORDS, budget: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``."""
    marked = with_fingerprints(docs.select("doc_id", "text"), words=words)
    marked = materialize(marked.select("_row.doc_id", "fingerprint"), "marked")
    classes = simhash_classes(marked, budget)
    return marked.join(classes, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, words: int = WORDS, budget: int = MAX_BITS) -> DataFrame:
    """One document of each group, the one with the smallest doc_id; all columns stay.

    Of rows that repeat that doc_id within the group one stays. A row without
    doc_id cannot be named as a copy and stays.
    """
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    keyed = packed(docs, docs["doc_id"].alias("doc_id"), text_hash.alias("text_hash"))
    marked = with_fingerprints(docs.select("doc_id", "text", text_hash.alias("text_hash")), words=words)
    ids = materialize(marked.select("_row.doc_id", "_row.text_hash", "fingerprint"), "marked")
    classes = simhash_classes(ids, budget)
    # The id may repeat within its group under other texts; one of them stays.
    own = ids.join(classes, "fingerprint").where("doc_id = component_id")
    first = own.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("first.*")
    one = keyed.join(first, ["doc_id", "text_hash"])
    one = one.dropDuplicates(["doc_id", "text_hash"])
    return one.select("_row.*").unionByName(docs.where(F.col("doc_id").isNull()))
