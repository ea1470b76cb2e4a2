from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parlance.llm import simhash


def plain(text, words=4):
    parts = (text or "").encode().lower().split()
    shingles = [parts[i : i + words] for i in range(len(parts) - words + 1)] or ([parts] if parts else [])
    h = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in h) > len(h)) if h else 0


def classes(values, budget):
    """Smallest index that each fingerprint reaches, by comparing all pairs."""
    label = list(range(len(values)))
    v = np.array(values, np.uint64)
    near = [np.flatnonzero(np.bitwise_count(v ^ x) <= budget) for x in v]
    changed = True
    while changed:
        changed = False
        for i, friends in enumerate(near):
            low = min(label[j] for j in friends)
            if low < label[i]:
                label[i], changed = low, True
    return label


@pytest.mark.parametrize("text", ["", "one", "A b\tC", "a b c d", "Ä b c d e\x0bf", "x y z x y z x y z", "É f g h i"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain(text)


def test_close_pairs_finds_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 30, 3)).astype(np.uint64)
    v = np.unique(np.concatenate([base[:, None] ^ np.bitwise_xor.reduce(flips, axis=2)]).ravel())
    x, y = simhash.close_pairs(v, v, 0, 0, True, 4)
    got = {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist())}
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 4
    want = {(int(v[i]), int(v[j])) for i, j in zip(*np.nonzero(np.triu(near, 1)))}
    assert got == want and len(x) == len(want)


@pytest.mark.parametrize("leaf", [16, simhash.LEAF])
def test_trie_links_connect_as_brute_force(spark, leaf):
    """A small leaf takes the rounds over the table of node pairs."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    v = np.unique((base[:, None] ^ (np.uint64(1) << rng.integers(0, 64, (30, 12)).astype(np.uint64))).ravel())
    rows = spark.createDataFrame([(i, int(x.view(np.int64))) for i, x in enumerate(v)], "doc_id long, fingerprint long")
    edges = simhash.trie_links(rows.select("fingerprint"), 4, leaf)
    root = {r["id"]: r["component"] for r in simhash.components(edges).collect()}
    groups = defaultdict(set)
    for i, label in enumerate(classes(v.tolist(), 4)):
        groups[label].add(int(v[i].view(np.int64)))
    got = defaultdict(set)
    for x in v.view(np.int64).tolist():
        got[root.get(x, x)].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_near_copies_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    prints = [plain(r["text"]) for r in rows]
    want = {(r["doc_id"], f"{p:016x}", rows[c]["doc_id"]) for r, p, c in zip(rows, prints, classes(prints, 4))}
    assert {tuple(r) for r in simhash.near_copies(docs).collect()} == want


def test_odd_rows(odd_docs, no_docs):
    got = simhash.near_copies(odd_docs).collect()
    assert len(got) == 12
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["fingerprint"], r["component_id"]))
    assert by[3] == by[4] == by[5] == {("0" * 16, 3)}
    assert {c for _, c in by[2]} == {1}
    assert simhash.near_copies(no_docs).count() == 0


def test_keep_one(odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(3) == 1 and 4 not in ids and ids.count(None) == 2
    assert simhash.keep_one(no_docs).count() == 0


def test_keep_one_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (1, "q r s t u v")], "doc_id long, text string")
    assert sorted(r["text"] for r in simhash.keep_one(docs).collect()) == ["a b c d e", "q r s t u v"]


def test_copies_are_one_leaf(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three four five").alias("text"))
    got = simhash.near_copies(docs)
    assert got.where("component_id = 0").count() == 4000
