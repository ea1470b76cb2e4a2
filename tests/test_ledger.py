import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import prompts
from parlance.functions.vectors import expected_rating, last_before, softmax_at
from parlance.operators import model, reports
from parlance.plans import quality
from parlance.scripted import FirstWord, ScriptedClient
from parlance.sources.ledger import Ledger, identity


class Seventh(ScriptedClient):
    """Fails on every seventh row."""

    def loss(self, texts):
        if any(int(t.split()[1]) % 7 == 0 for t in texts):
            raise RuntimeError("down")
        return super().loss(texts)

    def embed(self, texts):
        if any(int(t.split()[1]) % 7 == 0 for t in texts):
            raise RuntimeError("down")
        return super().embed(texts)


class Silent(ScriptedClient):
    def loss(self, texts):
        raise AssertionError("asked again")

    embed = rating_logits = tokenize = loss


@pytest.fixture()
def dialogues(spark):
    rows = [(f"d{i}", f"dialogue {i} #A#: hi\n#B#: yo {'x' * i}") for i in range(30)]
    return spark.createDataFrame(rows, "dialogue_id string, dialogue string").repartition(3)


def scores(df, client, path, scale=None):
    return {r["dialogue_id"]: r for r in quality.score(df, scale or quality.fed_scale(), client, path).collect()}


def test_every_seventh_row_fails_then_is_mended(spark, folder, dialogues):
    path = folder + "/fed"
    first = scores(dialogues, Seventh, path)
    bad = {f"d{i}" for i in range(0, 30, 7)}
    assert {i for i, r in first.items() if r["error"]} == bad and len(first) == 30
    assert all(r["error"] == "RuntimeError: down" for i, r in first.items() if i in bad)
    assert all((None in r["metrics"].values()) == (i in bad) for i, r in first.items())
    rows = quality.long_rows(quality.score(dialogues, quality.fed_scale(), Seventh, path))
    counts = reports.report(rows.withColumn("run", F.lit("r")), ["run"]).where("metric = 'depth'").head()
    assert (counts["scored"], counts["missing"]) == (25, 5)
    # The other rows are not asked again, and a further job asks nothing.
    second = scores(dialogues, ScriptedClient, path)
    assert all(r["error"] is None and None not in r["metrics"].values() for r in second.values())
    assert all(second[i]["metrics"] == first[i]["metrics"] for i in first if i not in bad)
    stored = Ledger(spark, path, "array<double>").load().count()
    assert scores(dialogues, Silent, path) == second
    assert Ledger(spark, path, "array<double>").load().count() == stored


def test_vectors(spark, folder, dialogues):
    get = lambda client: {r["dialogue_id"]: r for r in model.embeddings(
        dialogues, ["dialogue_id"], F.col("dialogue"), client, folder + "/v").collect()}
    first = get(Seventh)
    assert sum(r["value"] is None for r in first.values()) == 5 == sum(r["error"] is not None for r in first.values())
    second = get(ScriptedClient)
    assert all(len(r["value"]) == 16 and r["error"] is None for r in second.values()) and get(Silent) == second


def test_null_texts_are_not_asked(spark, folder):
    rows = spark.createDataFrame([("a", None), ("b", "x")], "dialogue_id string, dialogue string")
    got = scores(rows, ScriptedClient, folder + "/l", quality.rubric_scale())
    assert (got["a"]["metrics"], got["a"]["error"]) == (None, None) and got["b"]["metrics"]["coherence"] is not None
    vectors = {r["dialogue_id"]: r["value"] for r in model.embeddings(rows, ["dialogue_id"], F.col("dialogue"), ScriptedClient).collect()}
    assert vectors["a"] is None and len(vectors["b"]) == 16
    none = rows.limit(0)
    assert scores(none, ScriptedClient, folder + "/none") == {}


def test_results_belong_to_a_client(spark, folder, dialogues):
    class Other(ScriptedClient):
        identity = "another model"

        def rating_logits(self, batch):
            return [[9.0, 0.0, 0.0] for _ in batch]

    one, path = dialogues.limit(1), folder + "/l"
    mine = scores(one, ScriptedClient, path, quality.rubric_scale())
    other = scores(one, Other, path, quality.rubric_scale())
    assert mine != other and scores(one, Silent, path, quality.rubric_scale()) == mine

    class Nameless:
        pass

    assert identity(Nameless).endswith("Nameless") and identity(FirstWord) == "scripted"
    ask = lambda c: model.generate(
        one, "s", ["dialogue_id"], prompts.question_request(F.col("dialogue")), c, prompts.QUESTION_PARAMS, folder + "/g"
    ).head()["response"]
    Other.reply = lambda self, system, user: "another"
    assert ask(FirstWord).startswith("first") and ask(Other) == "another" and ask(FirstWord).startswith("first")


def test_repeated_rows_share_their_result(spark, folder):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y")], "dialogue_id string, dialogue string")
    assert quality.score(rows, quality.rubric_scale(), ScriptedClient, folder + "/l").count() == 3


def test_a_failing_family_leaves_the_others(spark, dialogues):
    registry = quality.families(ScriptedClient) | {"bad": lambda d: d.select("nothing"), "long": lambda d: quality.g_eval(d, ScriptedClient)}
    tables, errors = quality.metric_tables(dialogues, registry)
    assert set(tables) == {"fed", "gpt_score", "g_eval", "long"} and list(errors) == ["bad"]
    wide = quality.attach_metrics(dialogues, tables, list(registry)).collect()
    assert len(wide) == 30 and all(r["bad"] is None and r["long"] == r["g_eval"] for r in wide)
    assert quality.metric_errors(dialogues, tables).count() == 0
    assert quality.metric_rows(dialogues, {}).count() == 0


def test_a_client_without_the_yes_token_is_an_error_row(spark, dialogues):
    class Old:
        identity = "old"

        def tokenize(self, batch):
            return [[1, 2, 3] for _ in batch]

    with pytest.raises(Exception, match="yes_id"):
        scores(dialogues, Old, None, quality.probe_scale())
    known = scores(dialogues.limit(2), Old, None, quality.probe_scale(9))
    assert all(set(r["metrics"].values()) == {None} for r in known.values())


def test_number_helpers_equal_the_columns(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(0, 4, rng.integers(0, 7)).tolist(), rng.standard_normal(3).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, tokens array<int>, logits array<double>")
    got = df.select("i", last_before(F.col("tokens"), F.lit(2)).alias("p"), softmax_at(F.col("logits"), F.lit(1)).alias("s"),
                    expected_rating(F.col("logits")).alias("r")).collect()
    for r, (_, tokens, logits) in zip(sorted(got), rows):
        weights = quality.softmax(logits)
        assert r["p"] == quality.before_last(tokens, 2) and r["s"] == pytest.approx(weights[1])
        assert r["r"] == pytest.approx(weights @ [1, 2, 3])


def test_scores_need_no_shuffle_by_criterion(spark, dialogues):
    """One exchange for the ledger's rows and one for the join, none of the dialogues' texts by metric."""
    plan = quality.fed(dialogues, ScriptedClient)._jdf.queryExecution().executedPlan().toString()
    assert "metric#" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
