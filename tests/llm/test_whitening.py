import math

import numpy as np
import pytest

from parlance.llm import whitening
from parlance.llm.queries import op12_whitening

SCHEMA = "vec_id long, embedding array<double>, n string, component string"


def table(spark, vectors, ids=None):
    ids = ids if ids is not None else range(len(vectors))
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], "a", "b") for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute(vectors):
    """Whitened rows, deviations, explained shares and values, from Python integers."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, dims = len(x), len(x[0])
    s = [sum(r[d] for r in x) for d in range(dims)]
    off = [[n * r[d] - s[d] for d in range(dims)] for r in x]
    cov = np.array([[sum(r[i] * r[j] for r in off) / n**3 for j in range(dims)] for i in range(dims)])
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1], vecs[:, ::-1]
    return np.array(off, float) / n @ vecs / np.sqrt(np.maximum(values, 1e-300)), [sum(v * v for v in r) for r in off], values / np.trace(cov)


def random_vectors(n, dims, seed=1, scale=1.0):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, dims)) @ rng.standard_normal((dims, dims)) * scale).astype(np.float32).astype(float)


@pytest.mark.parametrize("n, dims, scale", [(150, 5, 0.1), (90, 40, 0.3), (700, 7, 1e4)])
def test_equals_brute_force(spark, n, dims, scale):
    vectors = random_vectors(n, dims, scale=scale)
    want, dev, share = brute(vectors)
    got = whitening.whitening(table(spark, vectors)).toPandas()
    k = min(32, dims)
    assert len(got) == n * k and set(got["n"]) == {n}
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    w *= np.sign((w * want[:, :k]).sum(0))
    assert np.abs(w - want[:, :k]).max() < 1e-6
    assert [int(d) for d in got.groupby("vec_id")["deviation"].first()] == dev
    assert np.allclose(got.groupby("component")["explained"].first(), share[:k], rtol=1e-6)
    assert got["identity_error"].max() < 1e-8
    assert np.abs(np.cov(w.T, bias=True) - np.eye(k)).max() < 1e-8


@pytest.mark.parametrize("bits", [1, 7, 9, 23, 40])
def test_scatter_is_exact(bits):
    rng = np.random.default_rng(bits)
    y = rng.integers(0, 1 << bits, (whitening.ROWS + 77, 3)).astype(np.uint64)
    total = whitening.Scatter(3, bits)
    total.add(y)
    exact = y.astype(object)
    for i in range(3):
        assert sum(int(v) << 16 * k for k, v in enumerate(total.sums[:, i])) == exact[:, i].sum()
        for j in range(i, 3):
            assert sum(int(v) << 16 * k for k, v in enumerate(total.cross[:, i, j])) == (exact[:, i] * exact[:, j]).sum()


def test_odd_rows(spark):
    vectors = list(random_vectors(40, 3))
    odd = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 1.0, 1.0], [1.0, 2.0], [0.0, 0.0, 0.0], vectors[0]]
    ids = [*range(40), *range(100, 107), 0]
    got = whitening.whitening(table(spark, vectors + odd, ids)).toPandas()
    assert set(got["vec_id"]) == {*range(40), 106} and len(got) == 42 * 3
    want, dev, _ = brute(vectors + [odd[6], odd[7]])
    assert int(got[got["vec_id"] == 106]["deviation"].iloc[0]) == dev[40]
    assert whitening.whitening(table(spark, [None, []])).collect() == []
    nameless = whitening.whitening(table(spark, vectors, [None] * 40)).toPandas()
    assert len(nameless) == 120 and nameless["vec_id"].isna().all()


def test_no_spread(spark):
    flat = [[v, 1.0, 2 * v] for v in (0.5, 1.0, 1.5, 2.0)]
    got = whitening.whitening(table(spark, flat)).toPandas()
    by = got.groupby("component")["whitened"]
    assert by.apply(lambda s: s.isna().all()).tolist() == [False, True, True]
    assert got["identity_error"].max() < 1e-9 and abs(got["explained"].max() - 1) < 1e-9
    one = whitening.whitening(table(spark, [[1.0, 2.0]])).toPandas()
    assert one["whitened"].isna().all() and set(one["deviation"].map(int)) == {0} and set(one["identity_error"]) == {0.0}


def test_very_large_entries(spark):
    vectors = random_vectors(50, 2)
    vectors[0] = [1e30, -1e300]
    got = whitening.whitening(table(spark, vectors)).toPandas()
    assert len(got) == 100 and got["identity_error"].max() < 1e-4
    x = [[min(max(math.floor(64 * float(c)), -(1 << 62)), 1 << 62) for c in v] for v in vectors]
    off = [50 * x[3][d] - sum(r[d] for r in x) for d in range(2)]
    want = sum(v * v for v in off)
    shown = got[got["vec_id"] == 3]["deviation"].iloc[0]
    assert shown is None if want >= 10**38 else int(shown) == want


def test_query(spark, sf):
    got = op12_whitening(spark, sf)
    assert dict(got.dtypes)["deviation"] == "bigint"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert got.count() == rows * 32 and got.agg({"identity_error": "max"}).head()[0] < 1e-8
