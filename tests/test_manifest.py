import pytest
from pyspark.sql import functions as F

from parlance.plans.generation import Run, execute, latest
from parlance.scripted import ScriptedClient
from parlance.sources.manifest import Manifest


@pytest.fixture()
def inputs(spark):
    topics = spark.createDataFrame([(0, "Pets"), (1, "Food"), (2, "Sea")], "topic_pos long, base_topic string")
    seeds = spark.createDataFrame([(str(i), f"d{i}", f"s{i}") for i in range(5)], "id string, dialogue string, summary string")
    return topics, seeds


def make(spark, folder, run_id="r", **options):
    return Run(spark, folder + "/run", ScriptedClient, n_sub_topics=1, n_personas=3, run_id=run_id, disable_metrics=True, **options)


def test_later_stages_never_read_an_earlier_run(spark, folder, inputs):
    topics, seeds = inputs
    execute(make(spark, folder, "one"), topics, seeds)
    assert latest(make(spark, folder), ["judged", "summaries"]).count() == 3
    execute(make(spark, folder, "two", disable_judge=True), topics.where("topic_pos = 1"), seeds)
    run = make(spark, folder)
    table = latest(run, ["judged", "summaries", "dialogues"])
    assert "llm_judge_score" not in table.columns and table.count() == 1
    assert run.manifest.current(["judged"]) is None and run.manifest.current(["summaries"]).run_id == "two"
    # The judge stage of the second run makes the judged table current again.
    execute(make(spark, folder, "three", stage="llm_judge"))
    judged = make(spark, folder).manifest.current(["judged", "summaries", "dialogues"])
    assert (judged.name, judged.run_id, judged.rows) == ("judged", "three", 1)
    # New summaries without judge scores are newer than those scores.
    execute(make(spark, folder, "four", stage="summary", disable_judge=True), seeds=seeds)
    assert make(spark, folder).manifest.current(["judged", "summaries"]).name == "summaries"


def test_imported_dialogues_are_a_new_root(spark, folder, inputs):
    execute(make(spark, folder, "one"), *inputs)
    rows = spark.read.parquet(folder + "/run/dialogues").limit(2)
    execute(make(spark, folder, "two", stage="llm_judge"), dialogues=rows.withColumn("dialogue", F.lit("#A#: new")))
    current = make(spark, folder).manifest.current(["judged", "summaries", "dialogues"])
    assert (current.name, current.run_id, current.rows) == ("judged", "two", 2)
    assert make(spark, folder).manifest.current(["summaries"]) is None


def test_an_interrupted_write_is_not_read(spark, folder, inputs):
    execute(make(spark, folder, "one"), *inputs)
    manifest = make(spark, folder).manifest
    manifest._append("judged", "v", manifest.current(["summaries"]).version, "lost", "started", None)
    assert manifest.current(["judged", "summaries"]).name == "summaries"
    manifest._append("dialogues", "w", None, "lost", "started", None)
    with pytest.raises(FileNotFoundError):
        latest(make(spark, folder), ["judged", "summaries", "dialogues"])


def test_a_failing_step_keeps_its_parent(spark, folder, inputs):
    class NoSummary(ScriptedClient):
        identity = "none"

    run = Run(spark, folder + "/run", NoSummary, n_sub_topics=1, n_personas=3, disable_metrics=True)
    execute(run, inputs[0], inputs[1])
    broken = make(spark, folder, stage="summary")
    broken.templates = None
    out = execute(broken, seeds=inputs[1])
    assert "summary" in broken.step_errors and "judge" in broken.step_errors
    assert "summary" not in out.columns and broken.manifest.current(["dialogues"]).version == broken.head


def test_records(spark, folder):
    manifest = Manifest(spark, folder + "/m", "a")
    assert manifest.records() == [] and manifest.current(["a"]) is None and manifest.table().count() == 0
    table, rows, version = manifest.save("a", spark.range(5), "one", None)
    assert (rows, table.count()) == (5, 5)
    _, _, child = manifest.save("x/b", spark.range(2), "one", version)
    assert manifest.current(["a", "x/b"]).version == child and manifest.table().count() == 4
    manifest.save("a", spark.range(3), "two", None)
    assert manifest.current(["x/b"]) is None and manifest.current(["a", "x/b"]).run_id == "two"
    with open(folder + "/m/manifest/0000000009.json", "w") as f:
        f.write('{"seq": 9, "na')
    assert len(manifest.records()) == 6 and manifest.current(["a"]).rows == 3
