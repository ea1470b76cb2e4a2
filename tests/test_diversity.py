import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import tokens, vectors
from parlance.functions.rouge import score
from parlance.operators import diversity, model
from parlance.plans.corpus import corpus_diversity
from parlance.scripted import ScriptedClient


def texts_by_file():
    rng = random.Random(1)
    words = ["running", "runs", "dog", "dogs", "tree", "leaf", "blue", "happily", "sky"]
    line = lambda: " ".join(rng.choices(words, k=rng.randint(2, 9)))
    return {
        "many": [line() for _ in range(75)], "two": [line(), line()], "one": [line()], "mute": ["!!", "??"],
        "gaps": [None, line(), None, line(), line()],
    }


def frame(spark, files):
    rows = [(f, i, t) for f, ts in files.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "file string, i int, t string").repartition(3)


def mean_max(texts, pair):
    if len(texts) < 2:
        return None
    return float(np.mean([max(pair(a, b) for j, b in enumerate(texts) if j != i) for i, a in enumerate(texts)]))


@pytest.mark.parametrize("k, block", [(200, 512), (40, 512), (None, 512), (None, 8), (None, 1)])
def test_rouge_and_cosine_equal_the_loops(spark, monkeypatch, k, block):
    for name in ("rouge_row_maxima", "cosine_row_maxima"):
        plain = getattr(diversity, name)
        monkeypatch.setattr(f"parlance.plans.corpus.{name}", lambda *args, plain=plain: plain(*args, block=block))
    files = texts_by_file()
    client = ScriptedClient()

    def cosine(a, b):
        u, v = np.array(client.embed([a, b]))
        size = np.linalg.norm(u) * np.linalg.norm(v)
        return float(u @ v / size) if size else 0.0

    got = {r["file"]: r for r in corpus_diversity(frame(spark, files), "file", ["i"], "t", ScriptedClient, k).collect()}
    for name, texts in files.items():
        texts = [t for t in texts if t is not None][:k]
        row = got[name]
        assert row["rows"] == len(texts)
        for column, pair in (("rouge", lambda a, b: score(a, b, True)), ("cosine", cosine)):
            want = mean_max(texts, pair)
            assert row[column] == (None if want is None else pytest.approx(want, abs=1e-6)), (name, column)


def test_every_row_has_its_best_partner(spark):
    """A whole file in small blocks, with copies, repeated tokens and texts without tokens."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)] + ["the"] * 20
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 40))) for _ in range(30)]
    texts = base + base[:8] + [" ".join(t.split()[:-2] + ["new"]) for t in base] + ["", "?!", "the the the", "the the"]
    df = frame(spark, {"f": texts, None: texts[:20]})
    for block in (7, 512):
        got = {(r["file"], r["i"]): r["best_rouge"] for r in diversity.rouge_row_maxima(df, "file", "i", "t", True, block).collect()}
        for name, part in (("f", texts), (None, texts[:20])):
            for i, t in enumerate(part):
                assert got[name, i] == max(score(t, o, True) for j, o in enumerate(part) if j != i), (block, name, i)


def test_few_subsequences_are_computed(monkeypatch):
    """Bounds settle most pairs of a block; a pair of unlike blocks takes no product."""
    rng = random.Random(6)
    groups = [[f"g{g}w{i}" for i in range(40)] for g in range(12)]
    texts = [" ".join(rng.choices(g, k=30)) for g in groups for _ in range(10)]
    calls = []
    plain = diversity.rouge.lcs_length
    monkeypatch.setattr(diversity.rouge, "lcs_length", lambda *a: calls.append(1) or plain(*a))
    ids = tokens.Ids(False)
    block = diversity.Block([ids.of(t) for t in texts])
    best = np.zeros(len(texts))
    diversity.best_rouge(block, None, best)
    computed = len(calls)
    assert best.tolist() == [max(score(a, b) for j, b in enumerate(texts) if j != i) for i, a in enumerate(texts)]
    assert computed < 700 < 120 * 119 // 2
    other = diversity.Block([ids.of(f"x{i} y{i}") for i in range(5)])
    assert diversity.hopeless(block, other, best, np.zeros(5))


def test_numbered_tokens_overlap_as_multisets():
    rng = random.Random(2)
    for _ in range(50):
        a, b = (np.array(rng.choices(range(-3, 6), k=rng.randint(0, 12)), np.int64) for _ in range(2))
        want = sum((Counter(a.tolist()) & Counter(b.tolist())).values())
        assert len(np.intersect1d(tokens.numbered(a), tokens.numbered(b))) == want


def test_token_ids_and_dictionary(spark):
    df = spark.createDataFrame([("Running dogs, the dogs!",), ("the dog runs",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(tokens.token_ids(F.col("t"), True)).collect()]
    assert got[0][0] == got[1][2] and got[0][1] == got[0][3] == got[1][1] and got[2:] == [None, []]
    words = {r["token"]: (r["stem"], r["rows"]) for r in tokens.dictionary(df, "t").collect()}
    assert words == {"running": ("run", 1), "dogs": ("dog", 1), "the": ("the", 2), "dog": ("dog", 1), "runs": ("run", 1)}
    assert tokens.dictionary(df.limit(0), "t").collect() == []


def test_no_rows(spark):
    empty = frame(spark, {"x": [None]})
    assert diversity.diversity_rouge(empty, "file", ["i"], "t").count() == 0


def test_failed_embedding_leaves_the_row_out(spark):
    class Picky(ScriptedClient):
        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return super().embed(texts)

    df = frame(spark, {"f": ["tea", "bad", "tea", "rod"]})
    row = corpus_diversity(df, "file", ["i"], "t", Picky).head()
    client = ScriptedClient()
    a, b = np.array(client.embed(["tea", "rod"]))
    cos = float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    assert row["cosine"] == pytest.approx((1 + 1 + cos) / 3)


def test_embedding_match(spark):
    p, r = [[1.0, 0.0], [1.0, 1.0]], [[0.0, 1.0], [1.0, 0.0], [2.0, 0.0]]
    df = spark.createDataFrame([(p, r), ([], r), (None, r)], "p array<array<double>>, r array<array<double>>")
    got = [x["m"] for x in df.select(vectors.embedding_match("p", "r").alias("m")).collect()]
    half = 2 ** -0.5
    precision, recall = (1 + half) / 2, (half + 1 + 1) / 3
    assert got[0]["precision"] == pytest.approx(precision)
    assert got[0]["recall"] == pytest.approx(recall)
    assert got[0]["f1"] == pytest.approx(2 * precision * recall / (precision + recall))
    assert got[1]["f1"] == 0.0
    assert got[2]["precision"] is None and got[2]["recall"] is None and got[2]["f1"] is None


def test_logits(spark):
    df = spark.createDataFrame([([1000.0, 1001.0, 999.0], [5, 7, 5, 7, 2])], "x array<double>, t array<int>")
    e = np.exp([0.0, 1.0, -1.0])
    row = df.select(
        vectors.softmax_at(F.col("x"), F.lit(1)).alias("p"), vectors.expected_rating(F.col("x")).alias("r"),
        vectors.last_before(F.col("t"), F.lit(7)).alias("a"), vectors.last_before(F.col("t"), F.lit(9)).alias("b"),
        vectors.last_before(F.array(F.lit(7)), F.lit(7)).alias("c"),
    ).head()
    assert row["p"] == pytest.approx(e[1] / e.sum())
    assert row["r"] == pytest.approx((e * [1, 2, 3]).sum() / e.sum())
    assert (row["a"], row["b"], row["c"]) == (2, None, None)


def test_each_or_batch_isolates():
    def call(batch):
        if "x" in batch:
            raise ValueError("bad")
        return [b.upper() for b in batch]

    assert model.each_or_batch(call, ["a", "x", "b"]) == (["A", None, "B"], [None, "ValueError: bad", None])
    assert model.each_or_batch(call, []) == ([], [])


def test_copies_are_searched_once(spark, monkeypatch):
    """A file of copies alone makes no pair of blocks; one with a single text keeps its scores."""
    made, plain = [], diversity._compare

    def compare(rows, file, inside, best):
        made.append((inside, rows.count()))
        return plain(rows, file, inside, best)

    monkeypatch.setattr(diversity, "_compare", compare)
    texts = {"copies": ["red dog", "red dog", "blue sky here", "Blue sky, here"] * 6, "mute": ["!!"] * 3, "same": ["one"] * 2}
    got = {(r["file"], r["i"]): r["best_rouge"] for r in diversity.rouge_row_maxima(frame(spark, texts), "file", "i", "t", True, 1).collect()}
    assert got == {(f, i): 0.0 if f == "mute" else 1.0 for f, ts in texts.items() for i in range(len(ts))}
    assert made == [(True, 4)]
    # One open text among copies meets every block; the copies need not meet each other.
    texts = {"f": ["red dog", "blue sky"] * 3 + ["dog red fox"]}
    got = {r["i"]: r["best_rouge"] for r in diversity.rouge_row_maxima(frame(spark, texts), "file", "i", "t", True, 1).collect()}
    assert got == {i: 1.0 for i in range(6)} | {6: pytest.approx(0.4)}
