import json
import os

import pytest

from parlance import job
from parlance.sources import tables


def test_run_then_diversity(spark, folder):
    topics, seeds = os.path.join(folder, "topics.txt"), os.path.join(folder, "seeds.jsonl")
    with open(topics, "w") as f:
        f.write("Pets\nFood\n")
    with open(seeds, "w") as f:
        f.write("\n".join(json.dumps({"dialogue": f"d{i}", "summary": f"s{i}"}) for i in range(4)))
    out, csv = folder + "/out", folder + "/csv"
    job.main(["run", "--client", "parlance.scripted:ScriptedClient", "--out", out, "--topics", topics, "--seeds", seeds,
              "--n-sub-topics", "2", "--n-personas", "3", "--disable-metrics", "--csv", csv])
    assert spark.read.parquet(out + "/judged").count() > 0
    # Dialogue CSVs of two generated files.
    data = folder + "/generated"
    os.makedirs(data)
    rows = spark.read.parquet(out + "/dialogues").selectExpr("sub_topic AS topic", "persona_1", "persona_2", "dialogue", "cot")
    pdf = rows.toPandas()
    for name in ("one_x.csv", "two_y.csv"):
        pdf.to_csv(f"{data}/{name}", index=False)
    report = folder + "/report"
    for run in ("a", "b"):
        job.main(["diversity", "--client", "parlance.scripted:ScriptedClient", "--folder", data, "--report", report, "--run-id", run])
    got = spark.read.parquet(report).collect()
    assert {(r["run_id"], r["file_name"], r["metric"]) for r in got} == {
        (r, f, m) for r in "ab" for f in ("one_x.csv", "two_y.csv") for m in ("rouge", "cosine")
    }
    assert all(0 < r["value"] <= 1.000001 for r in got)
    assert tables.finished(spark, csv)


def test_unknown_stage_is_refused():
    with pytest.raises(SystemExit):
        job.arguments(["run", "--client", "a:b", "--out", "x", "--stage", "everything"])


def test_exported_run_is_read_back(spark, folder):
    """The CSV of a whole run, metrics as JSON, goes through the diversity command."""
    with open(folder + "/topics.txt", "w") as f:
        f.write("Pets\nFood\n")
    with open(folder + "/seeds.jsonl", "w") as f:
        f.write("\n".join(json.dumps({"dialogue": f"d{i}", "summary": f"s{i}"}) for i in range(4)))
    client = ["--client", "parlance.scripted:ScriptedClient"]
    job.main(["run", *client, "--out", folder + "/out", "--topics", folder + "/topics.txt", "--seeds", folder + "/seeds.jsonl",
              "--n-sub-topics", "2", "--n-personas", "3", "--csv", folder + "/in/run.csv"])
    header = next(open(folder + "/in/run.csv/" + n).readline() for n in sorted(os.listdir(folder + "/in/run.csv")) if n.endswith(".csv"))
    assert {"fed", "gpt_score", "g_eval", "dialogue"} <= set(header.strip().replace('"', "").split(","))
    job.main(["diversity", *client, "--folder", folder + "/in", "--report", folder + "/report", "--run-id", "a"])
    got = {r["metric"]: r for r in spark.read.parquet(folder + "/report").collect()}
    assert set(got) == {"rouge", "cosine"} and got["rouge"]["file_name"] == "run.csv" and 0 < got["rouge"]["value"] <= 1


def test_training_and_scoring_commands(spark, folder):
    """Sets, predictions of two runs, and both scores, each by its command."""
    talk = lambda i: f"#A#: tea {i}\n#B#: yes {i}\n#A#: now {i}"
    make = lambda tag, n: spark.createDataFrame([(f"{tag}{i}", talk(i), f"sum {i}") for i in range(n)], "id string, dialogue string, summary string")
    make("s", 4).withColumnRenamed("id", "dialogue_id").write.parquet(folder + "/syn")
    make("c", 9).write.parquet(folder + "/corpus")
    tables.export_csv(make("t", 3), folder + "/test.csv")
    for kind in ("response", "summary"):
        job.main(["training-sets", "--synthetic", folder + "/syn", "--corpus", folder + "/corpus", "--test", folder + "/test.csv",
                  "--kind", kind, "--out", folder + "/sets-" + kind])
        counts = {(r["dataset"], r["split"]): r["count"] for r in spark.read.parquet(folder + "/sets-" + kind).groupBy("dataset", "split").count().collect()}
        assert counts == {("synthetic", "train"): 4, ("in_domain", "train"): 4, ("synthetic", "test"): 3, ("in_domain", "test"): 3}
    for kind in ("response", "summary"):
        for run, client in (("one", "EchoFirst"), ("two", "EchoAll")):
            job.main(["predict", "--kind", kind, "--client", f"parlance.scripted:{client}", "--test", folder + "/test.csv",
                      "--run-id", run, "--out", folder + "/" + kind])
        assert spark.read.parquet(folder + "/" + kind).count() == 6
    scripted = ["--client", "parlance.scripted:ScriptedClient"]
    for command, kind in (("score-responses", "response"), ("score-summaries", "summary")):
        job.main([command, *scripted, "--predictions", folder + "/" + kind, "--test", folder + "/test.csv", "--report", folder + "/report-" + kind])
    got = {(r["run_id"], r["metric"]): r for r in spark.read.parquet(folder + "/report-response").collect()}
    assert set(got) == {(r, m) for r in ("one", "two") for m in ("rouge_l", "bert_score")} and got["one", "rouge_l"]["scored"] == 3
    got = {(r["run_id"], r["metric"]): r for r in spark.read.parquet(folder + "/report-summary").collect()}
    assert set(got) == {(r, m) for r in ("one", "two") for m in ("rouge_l", "bert_score", "qags")}
    assert all((r["scored"], r["missing"]) == (3, 0) for r in got.values())
    # The whole dialogue answers its questions as itself.
    assert abs(got["two", "qags"]["mean"] - 1) < 1e-9 > abs(got["one", "qags"]["missing"])
    rows = make("f", 3).selectExpr("dialogue", "summary AS predicted_summary", "summary")
    tables.export_csv(rows, folder + "/file.csv")
    job.main(["score-file", *scripted, "--csv", folder + "/file.csv", "--run-id", "r", "--report", folder + "/report-file"])
    got = {r["metric"]: (r["run_id"], round(r["mean"], 6)) for r in spark.read.parquet(folder + "/report-file").collect()}
    assert got == {"rouge_l": ("r", 1.0), "bert_score": ("r", 1.0)}
