"""Nearest neighbours and embedding near-dedup against brute force."""

import tracemalloc

import numpy as np
import pytest

from parlance.llm import ann, pq

VECTORS = "vec_id long, embedding array<double>, label string, _row string, score string"


def vector_row(vec_id, v, label="a"):
    return (vec_id, None if v is None else [None if x is None else float(x) for x in v], label, "x", "y")


@pytest.fixture(scope="module")
def vectors():
    """Tight groups, exact copies, ties, and vectors that take no part."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(240):
        v = centres[i % 12] + 0.12 * rng.normal(size=16) * (i % 5)
        rows.append(vector_row(i, v, "ab"[i % 12 % 2] if i % 17 else None))
    rows += [vector_row(300 + i, centres[0], "a") for i in range(30)]
    rows += [
        vector_row(400, None), vector_row(420, [0.0] * 16), vector_row(440, [float("nan")] + [1.0] * 15),
        vector_row(460, [float("inf")] + [1.0] * 15), vector_row(480, [None] + [1.0] * 15),
        vector_row(500, [1.0, 2.0]), vector_row(520, []), vector_row(None, centres[1]),
    ]
    return rows


def good(rows):
    return {
        r[0]: np.array(r[1]) for r in rows
        if r[0] is not None and r[1] and len(r[1]) == 16 and None not in r[1]
        and np.isfinite(r[1]).all() and np.any(r[1])
    }


def test_search_equals_brute_force(spark, vectors):
    rows = spark.createDataFrame(vectors, VECTORS)
    got = {}
    for r in ann.search(rows, rows.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    data = good(vectors)
    asked = [i for i in data if i % 20 == 0]
    assert set(got) == set(asked)
    hits = total = 0
    for q in asked:
        scores = {i: float(data[q] @ v) for i, v in data.items() if i != q}
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert all(abs(scores[i] - s) < 1e-9 for _, i, s in mine)
        assert [i for _, i, _ in mine] == [i for _, i, _ in sorted(mine, key=lambda m: (-m[2], m[1]))]
        least = sorted(scores.values(), reverse=True)[19]
        hits += sum(s >= least - 1e-9 for _, _, s in mine)
        total += 20
    assert hits / total >= 0.9


def test_search_of_few_and_of_none(spark):
    two = spark.createDataFrame([vector_row(0, [1, 2]), vector_row(1, [2, 1]), vector_row(1, [2, 1])], VECTORS)
    found = ann.search(two, two.where("vec_id = 0")).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 1, 4.0), (2, 1, 4.0)]
    none = spark.createDataFrame([], VECTORS)
    assert ann.search(none, none).count() == 0
    assert ann.search(two, none).count() == 0


def brute_links(rows, cosine):
    data, label = good(rows), {r[0]: r[2] for r in rows}
    ids = sorted(data)
    unit = {i: data[i] / np.linalg.norm(data[i]) for i in ids}
    near = {
        i: [j for j in ids if j != i and label[i] is not None and label[i] == label[j] and unit[i] @ unit[j] >= cosine]
        for i in ids
    }
    component = {}
    for i in sorted(label, key=lambda x: (x is None, x)):
        if i is None or i in component:
            continue
        stack = [i]
        while stack:
            at = stack.pop()
            if at not in component:
                component[at] = i
                stack += near.get(at, [])
    return {i: (len(near.get(i, [])), component[i]) for i in label if i is not None}


@pytest.mark.parametrize("block", [7, 4096])
def test_linked_equals_brute_force(spark, vectors, block):
    rows = spark.createDataFrame(vectors, VECTORS)
    got = {r["vec_id"]: r for r in pq.linked(rows, block=block).collect()}
    want = brute_links(vectors, pq.COSINE)
    assert set(got) == set(want) | {None}
    for i, (n, component) in want.items():
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n, component, i == component), i


def test_linked_of_none(spark):
    assert pq.linked(spark.createDataFrame([], VECTORS)).count() == 0
    odd = spark.createDataFrame([vector_row(1, None), vector_row(2, [0, 0], None)], VECTORS)
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in pq.linked(odd).collect()} == {
        (1, 0, 1, True), (2, 0, 2, True)
    }


def test_index_of_many_lists_holds_few_distances():
    """24 million vectors of 10 labels make 1,171 lists: 187 MB for each matrix of all distances."""
    x = np.random.default_rng(5).standard_normal((pq.SAMPLE, 4))
    tracemalloc.start()
    try:
        index = pq.Index(x, 1_171)
        own = index.file(x)[0]
        probed = [np.concatenate(y) for y in zip(*index.probes(x[:10_000], 0.01, np.full(1_171, 0.05)))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 64 << 20
    for i in (0, 4_321, 9_999, 19_999):
        assert own[i] == ((x[i] - index.coarse) ** 2).sum(1).argmin()
    d = np.sqrt(((x[9_999] - index.coarse) ** 2).sum(1))
    apart = np.sqrt(((index.coarse[own[9_999]] - index.coarse) ** 2).sum(1))
    want = (d * d - d.min() ** 2 <= 0.02 * apart + 1e-9) & (d <= 0.06 + 1e-9)
    assert probed[1][probed[0] == 9_999].tolist() == np.flatnonzero(want).tolist()


def test_vectors_of_any_size_are_searched(spark):
    """Components from 1e-20 to 1e20, and up to 1e140 in doubles, whose products still fit."""
    rng = np.random.default_rng(7)
    for top in (1.0, 1e20, 1e140, 1e-20):
        x = rng.standard_normal((200, 8)) * top
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = {}
        for r in ann.search(df, df.where("vec_id % 20 = 0"), k=5).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
        assert len(got) == 10
        hits = 0
        for q, found in got.items():
            score = (x * x[q]).sum(1)
            want = [i for i in np.argsort(-score, kind="stable") if i != q][:5]
            hits += len({i for _, i in found} & set(want))
        assert hits >= 45, top


def test_repeated_ids_keep_their_links(spark):
    near = [[1.0, 0.0, 0.01], [1.0, 0.0, 0.02]]
    rows = [(7, near[0], 1), (7, near[1], 1), (8, [0.0, 1.0, 0.0], 1), (7, [0.0, 1.0, 0.0], 2), (9, [0.0, 1.0, 0.1], 2), (5, [0.0, 1.0, 0.05], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in pq.linked(df).collect())
    assert got == sorted([(7, 1, 7, True), (7, 1, 7, True), (8, 0, 8, True), (7, 2, 5, False), (9, 2, 5, False), (5, 2, 5, True)])


def test_few_rows_are_reranked_and_found(spark, sf):
    """On 64 dimensions of unclustered vectors: the share of rows reranked, the recall, and the bounds' reliability."""
    rng = np.random.default_rng(11)
    rows = [r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("embedding").collect()]
    for x in (rng.standard_normal((6000, 64)), np.array(rows, float)):
        coder, ids = ann.Coder(x.shape[1], x.mean(0)), np.arange(len(x))
        codes, scalars = coder.encode(x)
        asked = ids[:: max(20, len(x) // 60)]
        found = list(coder.search(x[asked], asked, ids, x, codes, scalars, 20, ann.ERROR))
        hits = reranked = 0
        for q, (got, _, near) in zip(asked, found):
            score = x @ x[q]
            score[q] = -np.inf
            hits += len(set(got.tolist()) & set(np.argsort(-score, kind="stable")[:20].tolist()))
            reranked += near
        assert hits >= 0.99 * 20 * len(asked)
        if len(x) == 6000:
            assert reranked < 0.1 * len(x) * len(asked)
            unit = x[0] / np.linalg.norm(x[0])
            levels = [np.ascontiguousarray(codes[:, i]) for i in range(ann.LEVELS)]
            guess, wide = coder.estimates(unit @ coder.rotation, levels, [ann._popcount(c) for c in levels], scalars, ann.ERROR)
            off = np.abs((x - coder.centre) @ unit - guess)
            assert np.mean(off <= wide) > 0.99
