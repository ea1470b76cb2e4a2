import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import negatives
from parlance.llm.queries import op13_negatives

SCHEMA = "vec_id long, label int, embedding array<double>, rank string, score string"
EVERY = 10


def table(spark, rows):
    return spark.createDataFrame([(i, l, None if v is None else [None if x is None else float(x) for x in v], "a", "b")
                                  for i, l, v in rows], SCHEMA).repartition(3)


def brute(rows, every=EVERY, k=5):
    x = [(i, l, [math.floor(256 * float(c)) for c in v]) for i, l, v in rows]
    out = []
    for a, al, av in x:
        if a % every:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(av, v)), i, l) for i, l, v in x if i != a))
        for ps, p, _ in [s for s in scored if s[2] == al][:k]:
            inside = [s for s in scored if s[2] != al and 80 * -ps <= 100 * -s[0] <= 100 * -ps]
            out += [(a, p, r + 1, n, -ps, -ns) for r, (ns, n, _) in enumerate(inside[:k])]
    return sorted(out)


def mined(spark, rows, **options):
    got = negatives.mine(table(spark, rows), F.col("vec_id") % EVERY == 0, **options)
    return sorted(tuple(r) for r in got.collect())


def random_rows(n, dims, seed=1, labels=3, centres=4):
    rng = np.random.default_rng(seed)
    heart = rng.standard_normal((centres, dims))
    return [(i, int(rng.integers(labels)), (heart[rng.integers(centres)] + 0.3 * rng.standard_normal(dims)).tolist()) for i in range(n)]


@pytest.mark.parametrize("n, dims", [(150, 64), (120, 3), (90, 70), (60, 1)])
def test_equals_brute_force(spark, n, dims):
    rows = random_rows(n, dims)
    want = brute(rows)
    assert mined(spark, rows) == want
    assert want or dims == 1


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 64 * 16)
    monkeypatch.setattr(negatives, "ASK", 64 * 4)
    rows = random_rows(160, 64, seed=2)
    assert mined(spark, rows) == brute(rows)


def test_ties_and_hot_labels(spark):
    rng = random.Random(3)
    base = [[rng.choice([-1, 0, 1]) for _ in range(6)] for _ in range(4)]
    rows = [(i, 0 if i % 3 else rng.randrange(3), base[rng.randrange(4)]) for i in range(120)]
    want = brute(rows)
    assert want and mined(spark, rows) == want


def test_odd_rows(spark):
    rows = random_rows(60, 4)
    odd = [(None, 1, [1.0] * 4), (200, None, [1.0] * 4), (210, 1, None), (220, 1, []), (230, 1, [1.0, None, 1.0, 1.0]),
           (240, 1, [float("nan")] * 4), (250, 1, [float("-inf")] * 4), (260, 1, [1.0] * 3)]
    assert mined(spark, rows + odd) == brute(rows)
    zero = [(70, 0, [0.0] * 4)]
    assert mined(spark, rows + zero) == brute(rows + zero)
    assert mined(spark, odd) == [] and mined(spark, [(10, 1, [1.0])]) == []


def test_repeated_ids(spark):
    rows = random_rows(40, 4)
    twice = rows + [(3, rows[3][1], rows[3][2])]
    # A repeated candidate counts twice; a repeated anchor asks once and is not its own candidate.
    assert mined(spark, twice) == brute(twice)
    again = rows + [(10, *sorted([rows[10][1:], (2, [9.0] * 4)])[1])]
    got = [r for r in mined(spark, again) if r[0] == 10]
    first = [(10, *sorted([rows[10][1:], (2, [9.0] * 4)])[0])]
    assert got == [r for r in brute([r for r in rows if r[0] != 10] + first) if r[0] == 10]


def test_large_components(spark):
    rows = random_rows(40, 4) + [(50, 0, [1e20, -1e20, 3.0, 1e300]), (60, 0, [1e20, 1.0, 0.0, 0.0]), (61, 1, [1e20, 0.5, 0.0, 0.0])]
    most = negatives.limit(4)
    assert 100 * 4 * most**2 < 2**63
    clipped = [(i, l, [min(max(math.floor(256 * c), -most), most) / 256 for c in v]) for i, l, v in rows]
    assert mined(spark, rows) == brute(clipped)


@pytest.mark.parametrize("dims", [1, 2, 5, 64, 100])
def test_intervals_hold_the_products(dims):
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.integers(-300, 300, (200, dims)), rng.integers(-(10**6), 10**6, (50, dims)), np.zeros((1, dims), np.int64)])
    turn = negatives.rotation(dims)
    codes, scalars = negatives.encode(x, turn)
    for row in x[[0, 1, 210, 250]]:
        low, high = negatives.Anchor(row, turn).interval(codes, scalars)
        exact = x @ row
        assert (low <= exact).all() and (exact <= high).all()


def test_intervals_filter():
    """On clustered vectors most rows are decided by their codes alone."""
    rows = random_rows(4000, 64, seed=5, labels=2, centres=40)
    x = np.array([[math.floor(256 * c) for c in v] for _, _, v in rows])
    turn = negatives.rotation(64)
    codes, scalars = negatives.encode(x, turn)
    ids = np.arange(len(x))
    _, _, scored = negatives.closest(negatives.Anchor(x[0], turn), x[0], 0, ids[1:], ids, x, codes, scalars, 5)
    assert 5 <= scored < 400


def test_query_equals_brute_force(spark, sf):
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"])
            for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in op13_negatives(spark, sf).collect()) == brute(rows, 100)
