import json

import pytest
from pyspark.sql import functions as F

from parlance.plans import generation, quality
from parlance.plans.generation import Run, execute
from parlance.scripted import ScriptedClient


@pytest.fixture(scope="module")
def inputs(spark):
    topics = spark.createDataFrame([(0, "Pets"), (1, "Food"), (2, "broken"), (3, "Pets")], "topic_pos long, base_topic string")
    seeds = spark.createDataFrame([(str(i), f"d{i} {{n}}", f"s{i}") for i in range(5)], "id string, dialogue string, summary string")
    return topics, seeds


class Client(ScriptedClient):
    def reply(self, system, user):
        if user == "The subject is broken.":
            return "no list here"
        if user.startswith("Let them talk") and "trends of Food" in user and "Second person: Someone" in system:
            raise RuntimeError("timeout")
        if "about delivery delays at Pets," in user:
            return "I cannot tell"
        return super().reply(system, user)


def make(spark, folder, **options):
    return Run(spark, folder + "/run", Client, n_sub_topics=3, n_personas=4, **options)


def test_run_and_resume(spark, folder, inputs):
    run = make(spark, folder, yes_id=7)
    out = execute(run, *inputs)
    # Two sub-topics and three personas stay of each list: 2 * 3 pairs per topic.
    assert run.counts["sub_topics"] == 6 and run.counts["dialogues"] == 18 - 2
    assert run.step_errors == {} and run.metric_errors == {}
    rows = out.collect()
    assert len({r["dialogue_id"] for r in rows}) == 16
    first = next(r for r in rows if r["base_topic"] == "Food" and r["sub_topic"].startswith("price"))
    assert first["cot"] == first["sub_topic"] and first["summary"].startswith("A talk of")
    assert len(first["fed"]) == 10 and len(first["gpt_score"]) == 10 and len(first["g_eval"]) == 4
    unscored = [r for r in rows if r["sub_topic"] == "delivery delays at Pets"]
    assert len(unscored) == 6 and all(r["llm_judge_score"] is None and r["judge_raw"] == "I cannot tell" for r in unscored)
    errors = {s: run.table(f"errors/{s}").collect() for s in ("sub_topics", "personas", "dialogues", "judge")}
    assert [(r["base_topic"], r["error"]) for r in errors["sub_topics"]] == [("broken", "not a list")]
    assert errors["personas"] == [] and len(errors["dialogues"]) == 2 and len(errors["judge"]) >= 6

    # A second run over the same folder asks only what failed.
    class Silent(ScriptedClient):
        def reply(self, system, user):
            if user.startswith("Let them talk") and "Food" in user:
                return super().reply(system, user)
            raise RuntimeError("asked again: " + user)

    rerun = Run(spark, run.out, Silent, n_sub_topics=3, n_personas=4, disable_judge=True, disable_metrics=True)
    execute(rerun, *inputs)
    assert rerun.counts["dialogues"] == 18
    assert rerun.table("errors/summary").count() == 2

    # Later stages start from the stage tables.
    judged = Run(spark, run.out, ScriptedClient, stage="llm_judge", attempt=1, disable_metrics=True)
    assert {"summary", "llm_judge_score"} <= set(execute(judged).columns)
    metrics = Run(spark, run.out, ScriptedClient, stage="metrics", registry={
        "g_eval": lambda d: quality.g_eval(d, ScriptedClient),
        "bad": lambda d: d.select("nothing"),
    })
    final = execute(metrics)
    assert list(metrics.metric_errors) == ["bad"]
    row = final.where(F.col("g_eval").isNotNull()).head()
    assert row["bad"] is None and set(row["g_eval"]) == {"engagingness", "naturalness", "coherence", "groundedness"}


def test_drop_scope_base_topic(spark, folder, inputs):
    run = make(spark, folder, drop_scope="base_topic", disable_judge=True, disable_metrics=True)
    out = execute(run, *inputs)
    assert {r["topic_pos"] for r in out.collect()} == {0, 3}


@pytest.mark.parametrize("options", [{"stage": "everything"}, {"drop_scope": "all"}])
def test_bad_options(spark, options):
    with pytest.raises(ValueError):
        Run(spark, "x", ScriptedClient, **options)


def test_missing_arguments(spark, folder, inputs):
    with pytest.raises(ValueError, match="n_personas"):
        execute(Run(spark, folder, ScriptedClient, n_sub_topics=3), *inputs)
    with pytest.raises(FileNotFoundError):
        execute(Run(spark, folder + "/none", ScriptedClient, stage="metrics"))


def test_equal_sub_topics_share_their_personas(spark, folder):
    rows = spark.createDataFrame([(0, "T", 0, "日本"), (0, "T", 1, "日本")], "topic_pos long, base_topic string, sub_pos int, sub_topic string")

    class Two(ScriptedClient):
        def reply(self, system, user):
            return json.dumps(["old man", "young woman"])

    got = generation.persona_step(Run(spark, folder + "/r", Two, n_personas=2), rows).collect()
    assert [r["personas"] for r in got] == [["old man", "young woman"] * 2]


def test_few_seeds_fail(spark):
    seeds = spark.createDataFrame([("1", "d", "s")], "id string, dialogue string, summary string")
    with pytest.raises(Exception, match="fewer than 4"):
        generation.few_shot(seeds, 1).collect()


def test_braces_in_examples_stay(spark, inputs):
    from parlance.functions import prompts

    one = spark.range(1).withColumn("e", generation.few_shot(inputs[1], 1).scalar())
    request = prompts.dialogue_request(F.col("e"), F.lit("{persona_2}"), F.lit("p2"), F.lit("t"))
    system = one.select(request.alias("m")).head()["m"][0]["content"]
    assert "{n}" in system and "First person: {persona_2}\nSecond person: p2" in system
