import random

import pytest
from pyspark.sql import functions as F

from parlance.functions import near, tokens
from parlance.functions.rouge import score
from parlance.operators import dedup, lists
from parlance.operators.dedup import greedy_filter


def keep_first(items, threshold=0.5):
    """The loop; a null item is one without tokens, which is like nothing and stays."""
    kept = []
    for item in items:
        if all((score(item, k) or 0.0) < threshold for k in kept):
            kept.append(item)
    return kept


CASES = [
    ["a b c d", "c d e f", "e f g h"],
    ["e f g h", "c d e f", "a b c d"],
    ["same one", "same one", "other two"],
    ["日本", "日本", "!!", "word"],
    [], ["only"],
    ["red ring", "red bolt", "blue bolt", "green cap"],
]


def test_lists_equal_the_loop(spark):
    rng = random.Random(5)
    cases = CASES + [[" ".join(rng.choices("abcdefg", k=rng.randint(1, 5))) for _ in range(20)] for _ in range(25)]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, items array<string>")
    got = {r["i"]: r["x"] for r in rows.select("i", lists.drop_repeated(F.col("items")).alias("x")).collect()}
    assert got == {i: keep_first(c) for i, c in enumerate(cases)}


def grouped(spark, groups):
    rows = [(g, p, t) for g, items in groups.items() for p, t in enumerate(items)]
    return spark.createDataFrame(rows, "g string, p int, t string").repartition(4)


def kept_by(df, groups, **options):
    got = {g: [] for g in groups}
    for r in sorted(greedy_filter(df, "g", "p", "t", **options).collect(), key=lambda r: (r["g"], r["p"])):
        got[r["g"]].append(r["t"])
    return got


def random_groups(seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choices([f"w{i}" for i in range(30)], k=rng.randint(3, 14))) for _ in range(12)]

    def near(text):
        words = text.split()
        words[rng.randrange(len(words))] = f"w{rng.randrange(30)}"
        return " ".join(words)

    hot = [near(rng.choice(base)) if rng.random() < 0.7 else rng.choice(base) for _ in range(90)]
    hot += ["?!", "?!", None]
    return {"hot": hot, "cold": base[:5], "one": ["x"]}


@pytest.mark.parametrize("options", [
    {}, {"local_items": 0, "window": 3}, {"local_items": 20, "window": 2},
])
def test_groups_equal_the_loop(spark, options):
    groups = random_groups(3)
    assert kept_by(grouped(spark, groups), groups, **options) == {g: keep_first(i) for g, i in groups.items()}


def test_long_posting_lists_are_cut(spark, monkeypatch):
    monkeypatch.setattr(dedup, "LIST_ROWS", 5)
    groups = random_groups(11)
    got = kept_by(grouped(spark, groups), groups, local_items=0, window=4, threshold=0.6)
    assert got == {g: keep_first(i, 0.6) for g, i in groups.items()}


def test_texts_are_not_sorted_to_find_the_first(spark):
    words = spark.createDataFrame([(1, "a b", "d", 3)], "_group long, _words string, _digest string, _pos long")
    plan = dedup.firsts(words)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("HashAggregate") == 2


def test_hot_leader_and_missing_group(spark):
    """A third of the rows copies one item with a word changed; the group itself is null."""
    rng = random.Random(9)
    hot = [f"one two three four five six seven eight nine w{i}" for i in range(40)]
    items = hot + [" ".join(rng.choices([f"x{i}" for i in range(60)], k=8)) for _ in range(80)]
    rng.shuffle(items)
    df = spark.createDataFrame([(None, p, t) for p, t in enumerate(items)], "g string, p int, t string")
    got = [r["t"] for r in greedy_filter(df, "g", "p", "t", local_items=0, window=4).orderBy("p").collect()]
    assert got == keep_first(items)


def test_token_arrays_are_never_broadcast(spark, monkeypatch):
    """A leader with many partners is cut; only numbers are sent to every executor."""
    narrow = dedup.lookup_join

    def checked(left, right, *args):
        assert not any(t.startswith("array") for _, t in right.dtypes)
        return narrow(left, right, *args)

    monkeypatch.setattr(dedup, "lookup_join", checked)
    monkeypatch.setattr(dedup, "LEADER_PAIRS", 3, raising=False)
    rng = random.Random(9)
    lists_ = [rng.choices(range(6), k=rng.randint(3, 7)) for _ in range(30)]
    items = spark.createDataFrame(list(enumerate(lists_)), "_id long, _ids array<long>")
    pairs = [(a, b) for a in (0, 1) for b in range(a + 1, 30)]
    found = dedup._similar(spark.createDataFrame(pairs, "a_id long, b_id long"), items, 0.5)
    text = [" ".join(f"w{t}" for t in x) for x in lists_]
    assert sorted(map(tuple, found.collect())) == sorted((a, b) for a, b in pairs if score(text[a], text[b]) >= 0.5)


def long_groups(seed):
    """Groups of texts of some 80 words, many of them near copies that differ in a few words, or in half of them."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["the", "of"] * 40
    base = [" ".join(rng.choices(words, k=rng.randint(60, 110))) for _ in range(14)]

    def near(text):
        out = text.split()
        for i in rng.sample(range(len(out)), rng.choice([3, len(out) // 2, len(out) * 6 // 10])):
            out[i] = rng.choice(words)
        return " ".join(out)

    long = [near(rng.choice(base)) for _ in range(120)] + base[:4]
    return {"long": long, "second": [near(t) for t in base * 3], "few": base[:2], "short": ["red ring", "red bolt", "red ring!"] * 9}


def test_long_texts_by_blocks_equal_the_loop(spark, monkeypatch):
    """Several blocks of a group, codes that fall together included; postings are made of short texts alone."""
    spread = dedup._postings

    def postings(items, threshold):
        assert {r["_n"] for r in items.select(F.size("_ids").alias("_n")).collect()} == {2}
        return spread(items, threshold)

    monkeypatch.setattr(dedup, "_postings", postings)
    monkeypatch.setattr(dedup, "BLOCK_ITEMS", 25)
    groups = long_groups(8)
    df, want = grouped(spark, groups), {g: keep_first(i) for g, i in groups.items()}
    assert len(want["long"]) < 100
    assert kept_by(df, groups, local_items=1, window=4) == want


def test_few_subsequences_are_computed_for_long_texts(monkeypatch):
    """Bounds settle nearly all pairs, and lose none."""
    rng = random.Random(3)
    texts = [t for g in ("long", "second") for t in long_groups(21)[g]]
    texts += ["", "w1", " ".join(f"w{rng.randrange(400)}" for _ in range(5_000))]
    ids = tokens.Ids(False)
    entries = [near.Entry(ids.of(t)) for t in texts]
    calls, plain = [], near.lcs_length
    monkeypatch.setattr(near, "lcs_length", lambda *a: calls.append(1) or plain(*a))
    for threshold in (0.5, 0.8):
        shelf = near.Shelf(threshold)
        for e in entries[: len(texts) // 2]:
            shelf.add(e)
        calls.clear()
        found = [(i, k) for i, e in enumerate(entries) for k in shelf.similar(e)]
        want = [(i, k) for i, t in enumerate(texts) for k in range(len(texts) // 2) if score(t, texts[k]) >= threshold]
        assert sorted(found) == want
        assert len(calls) < 2 * len(want)
