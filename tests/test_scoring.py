import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import vectors
from parlance.functions.rouge import score
from parlance.plans import datasets, quality, scoring
from parlance.scripted import EchoAll, EchoFirst, ScriptedClient


def matched(p, r):
    unit = lambda m: np.array(m) / np.linalg.norm(m, axis=1, keepdims=True)
    u, v = (unit(x) for x in ScriptedClient().token_vectors([p, r]))
    sims = u @ v.T
    a, b = sims.max(axis=1).mean(), sims.max(axis=0).mean()
    return 2 * a * b / (a + b)


def test_qags(spark):
    rows = spark.createDataFrame([
        ("1", "red dog ran far", "red cat", "red dog"), ("2", "no ]list here", "x", "y"), ("3", "two words", "b", "two"),
    ], "id string, dialogue string, summary string, predicted_summary string")
    qas = scoring.qa_rows(rows, ScriptedClient).collect()
    by_id = {r["id"]: r for r in qas}
    assert set(by_id) == {"1", "3"}
    assert by_id["1"]["questions"] == ["red", "dog", "ran"]
    assert by_id["1"]["answers_from_summary"] == ["red 1", "dog 1", "ran 0"]
    table = spark.createDataFrame(qas, "id string, questions array<string>, answers_from_dialogue array<string>, answers_from_summary array<string>")
    means = {r["id"]: r["mean"] for r in scoring.qags(table, ScriptedClient).collect()}
    scores = {i: [matched(s, d) for s, d in zip(r["answers_from_summary"], r["answers_from_dialogue"])] for i, r in by_id.items()}
    assert means == {i: pytest.approx(np.mean(v)) for i, v in scores.items()}
    # The second chunk holds the two questions of document 3 and is still divided by three.
    chunks = scoring.qags_chunked(table.withColumn("at", F.col("id").cast("long")), "at", ScriptedClient).orderBy("chunk").collect()
    assert [r["mean"] for r in chunks] == pytest.approx([sum(scores["1"]) / 3, sum(scores["3"]) / 3])


def test_unreadable_answers_drop_the_row(spark):
    class Odd(ScriptedClient):
        def reply(self, system, user):
            if user.startswith("Read this.\n\nshort"):
                return json.dumps(["only one"])
            return super().reply(system, user)

    rows = spark.createDataFrame([("1", "red dog ran", "s", "short"), ("2", "red dog ran", "s", "dog")],
                                 "id string, dialogue string, summary string, predicted_summary string")
    qas = scoring.qa_rows(rows, Odd)
    assert [r["id"] for r in scoring.qags(qas, ScriptedClient).collect()] == ["2"]


def test_runs_are_compared_on_one_test_set(spark):
    dialogues = ["a\nthe dogs ran\nthe dog runs", "one line", "x y\nz"]
    rows = spark.createDataFrame([(str(i), d) for i, d in enumerate(dialogues)], "id string, dialogue string")
    pairs = datasets.response_pairs(rows)
    assert sorted(r["id"] for r in pairs.collect()) == ["0", "2"]
    runs = {"first": EchoFirst, "all": EchoAll}
    table = None
    for name, client in runs.items():
        part = scoring.predict(pairs, "context", client, datasets_params(), name, "predicted_response")
        table = part if table is None else table.unionByName(part)
    got = {(r["run_id"], r["metric"]): r["mean"] for r in scoring.compare_runs(table, pairs, ScriptedClient).collect()}
    for name, predict in (("first", lambda c: c.split("\n")[0]), ("all", lambda c: c)):
        cases = [(r["response"], predict(r["context"])) for r in pairs.collect()]
        assert got[name, "rouge_l"] == pytest.approx(np.mean([score(r, p, True) for r, p in cases]))
        assert got[name, "bert_score"] == pytest.approx(np.mean([matched(p, r) for r, p in cases]))


def datasets_params():
    from parlance.functions.prompts import PREDICT_RESPONSE_PARAMS

    return PREDICT_RESPONSE_PARAMS


def test_training_sets(spark):
    make = lambda n, tag: spark.createDataFrame(
        [(f"{tag}{i}", f"{tag}\n{i}", "s") for i in range(n)], "id string, dialogue string, summary string")
    out = datasets.training_sets(make(3, "syn"), make(9, "dom"), make(2, "test"), kind="summary")
    counts = {(r["dataset"], r["split"]): r["count"] for r in out.groupBy("dataset", "split").count().collect()}
    assert counts == {("synthetic", "train"): 3, ("synthetic", "test"): 2, ("in_domain", "train"): 3, ("in_domain", "test"): 2}
    with pytest.raises(ValueError, match="sample of 9"):
        datasets.training_sets(make(9, "syn"), make(3, "dom"), make(2, "test"))
    with pytest.raises(ValueError, match="unknown kind"):
        datasets.training_sets(make(1, "a"), make(1, "b"), make(1, "c"), kind="other")


def test_missing_loss_makes_the_metric_null(spark):
    class Gap(ScriptedClient):
        def loss(self, texts):
            if any("Great talking" in t for t in texts):
                raise RuntimeError("oom")
            return super().loss(texts)

    df = spark.createDataFrame([("d", "#A#: hi\n#B#: yo")], "dialogue_id string, dialogue string")
    got = {r["metric"]: r["value"] for r in quality.fed(df, Gap).collect()}
    assert got["likeable"] is None and sum(v is None for v in got.values()) == 1
    base = len("#A#: hi\n#B#: yo") + len("\n    #A#: ")
    utterances = ["That's not what you said earlier!", "Stop contradicting yourself!"]
    assert got["consistent"] == pytest.approx(np.mean([base + len(u) for u in utterances]) / 100)


def test_vectors_are_matched_a_few_rows_at_a_time(spark):
    """More than sixteen texts at once get useless vectors here; a null text has nulls."""

    class Few(ScriptedClient):
        def token_vectors(self, texts):
            return super().token_vectors(texts) if len(texts) <= 16 else [[[0.0, 0.0]] for _ in texts]

    texts = [(i, "one two three", "four " * (i + 1) + "x") for i in range(100)]
    df = spark.createDataFrame([*texts, (100, None, "x")], "i int, p string, r string").coalesce(1)
    got = {r["i"]: r["m"] for r in df.select("i", scoring.bert_score(F.col("p"), F.col("r"), Few).alias("m")).collect()}
    assert [got[i]["f1"] for i, _, _ in texts] == pytest.approx([matched(p, r) for _, p, r in texts])
    assert got[100]["f1"] is None


def test_tiles_find_the_best_of_the_whole_product(monkeypatch):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(23, 4)), rng.normal(size=(9, 4))
    monkeypatch.setattr(vectors, "TILE", 4)
    sims = a @ b.T
    for got, want in zip(vectors.best_cosines(a, b), (sims.max(axis=1), sims.max(axis=0))):
        assert got == pytest.approx(want)


def test_texts_are_joined_with_their_questions_once(spark, monkeypatch):
    """Requests and keys are made from a written table: no plan of theirs shuffles a dialogue."""
    given, plain = [], scoring.answer_questions

    def answers(rows, passage, *args):
        given.append((rows.inputFiles(), rows._jdf.queryExecution().executedPlan().toString()))
        return plain(rows, passage, *args)

    monkeypatch.setattr(scoring, "answer_questions", answers)
    rows = spark.createDataFrame([("1", "red dog ran far", "red dog"), ("3", "two words", "two")], "id string, dialogue string, predicted_summary string")
    assert {r["id"] for r in scoring.qa_rows(rows, ScriptedClient).collect()} == {"1", "3"}
    runs = rows.select(F.lit("r").alias("run_id"), "id", "predicted_summary")
    assert {r["id"] for r in scoring.run_qa_rows(runs, rows, ScriptedClient).collect()} == {"1", "3"}
    assert len(given) == 4 and all(files and "Join" not in plan for files, plan in given)
