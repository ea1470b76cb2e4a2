import hashlib

import pytest
from pyspark.sql import functions as F

from parlance.operators import lists, reports, sampling
from parlance.operators.lists import check_count


def md5(seed, i):
    return hashlib.md5(f"{seed}/{i}".encode()).hexdigest()


@pytest.mark.parametrize("digits", [1, 3])
@pytest.mark.parametrize("n", [0, 1, 150, 400])
def test_sample_exact(spark, monkeypatch, n, digits):
    monkeypatch.setattr(sampling, "DIGITS", digits)
    df = spark.range(400)
    got = sorted(r["id"] for r in sampling.sample_exact(df, ["id"], n, 9).collect())
    assert got == sorted(sorted(range(400), key=lambda i: md5(9, i))[:n])


def test_sample_too_large(spark):
    with pytest.raises(ValueError):
        sampling.sample_exact(spark.range(3), ["id"], 4, 1)


def test_sample_of_repeated_ids(spark):
    df = spark.createDataFrame([(i // 10, i) for i in range(60)], "id int, v int")
    order = sorted(range(6), key=lambda i: md5(3, i))
    for n in (1, 10, 25, 60):
        got = [r["id"] for r in sampling.sample_exact(df, ["id"], n, 3).collect()]
        assert len(got) == n and sorted(got) == sorted([i for i in order for _ in range(10)][:n])


def test_few(spark):
    got = sorted(r["id"] for r in sampling.sample_few(spark.range(50), ["id"], 4, 2).collect())
    assert got == sorted(sorted(range(50), key=lambda i: md5(2, i))[:4])
    assert sampling.sample_few(spark.range(2), ["id"], 4, 2).count() == 2


def test_first_k(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    got = sampling.first_k(df, ["g"], ["id"], 5).collect()
    assert sorted((r["g"], r["pos"], r["id"]) for r in got) == [(g, i, g + 3 * i) for g in range(3) for i in range(5)]


@pytest.mark.parametrize("size", [0, 3, 4, 7, 1000])
def test_position_and_chunks(spark, size):
    df = spark.range(size).select((F.col("id") * 7 - 20).alias("k"), F.col("id").cast("double").alias("v")).repartition(3)
    got = sorted((r["k"], r["pos"]) for r in sampling.with_position(df, "k", parts=5).select("k", "pos").collect())
    assert got == [(i * 7 - 20, i) for i in range(size)]
    values = list(range(size))
    want = [sum(values[i : i + 3]) / 3 for i in range(0, size, 3)]
    chunks = sampling.chunked_mean(df, "k", "v", 3).orderBy("chunk").collect()
    assert [r["mean"] for r in chunks] == pytest.approx(want)


def test_pairs(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["x"]), (3, [])], "k int, p array<string>")
    got = [(r["k"], r["persona_1"], r["persona_2"]) for r in lists.explode_pairs(df, "p").collect()]
    assert got == [(1, *p) for p in (("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d"))]


@pytest.mark.parametrize("n", [None, 21, -1])
def test_count_is_checked(n):
    with pytest.raises(ValueError):
        check_count(n)


def test_zip_answers(spark):
    df = spark.createDataFrame(
        [(1, ["a", "b"], ["c", "d"]), (2, ["a"], ["b", "c"]), (3, None, ["a"]), (4, [], [])],
        "id int, l array<string>, r array<string>",
    )
    got = [tuple(r) for r in lists.zip_answers(df, "l", "r", ["id"]).orderBy("pos").collect()]
    assert got == [(1, 0, "a", "c"), (1, 1, "b", "d")]


def test_followup_scores(spark):
    rows = spark.createDataFrame(
        [("d", "both", "positive", 1.0), ("d", "both", "positive", 3.0), ("d", "both", "negative", 5.0),
         ("d", "neg", "negative", 2.0), ("d", "neg", "negative", 4.0),
         ("d", "gap", "negative", 2.0), ("d", "gap", "negative", None)],
        "id string, metric string, polarity string, loss double",
    )
    got = {r["metric"]: r["value"] for r in reports.followup_scores(rows, "id").collect()}
    assert got == {"both": 3.0, "neg": 3.0, "gap": None}


def test_positions_of_repeated_and_missing_keys(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("a", 4), ("c", 5)] * 20, "k string, v int")
    for parts in (1, 3, 64):
        got = sampling.with_position(rows, ["k", "v"], "at", parts).orderBy("at").collect()
        assert [r["at"] for r in got] == list(range(100))
        keys = [(r["k"] is not None, r["k"] or "", r["v"]) for r in got]
        assert keys == sorted(keys)
    assert sampling.with_position(rows.limit(0), "k").collect() == []
    numbers = spark.range(5000).selectExpr("hash(id) % 700 as x", "id")
    table = sampling.with_position(numbers, ["x", "id"], "at")
    bad = table.alias("a").join(table.alias("b"), F.expr("b.at = a.at + 1")).where("a.x > b.x or (a.x = b.x and a.id > b.id)")
    assert bad.isEmpty() and table.select("at").distinct().count() == 5000
