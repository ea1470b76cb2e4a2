"""spark-submit entry: ``job.py COMMAND ...``.

* ``run``: topics to judged dialogues; ``diversity``: of the dialogue CSVs of a folder.
* ``training-sets``: synthetic and size-matched in-domain pairs, both with the test set.
* ``predict``: summaries or responses of one run, appended to a table.
* ``score-summaries``, ``score-responses``: the runs of such a table against a test CSV.
* ``score-file``: a CSV that holds predictions and references.

Scores are appended to the report with their means and the numbers scored and missing.

``--client package.module:Name`` names a class without constructor arguments
that offers the methods of ``parlance.operators.model.Client``.
"""

from __future__ import annotations

import argparse
from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from parlance.functions import prompts
from parlance.plans import corpus, datasets, generation, scoring
from parlance.schemas import PREDICTION_CSV
from parlance.session import build_session
from parlance.sources import files, tables


def load_client(name: str):
    module, _, attribute = name.partition(":")
    return getattr(import_module(module), attribute)


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run")
    run.add_argument("--client", required=True)
    run.add_argument("--out", required=True)
    run.add_argument("--topics")
    run.add_argument("--seeds")
    run.add_argument("--dialogues", help="dialogue table (parquet) for a later stage")
    run.add_argument("--n-sub-topics", type=int)
    run.add_argument("--n-personas", type=int)
    run.add_argument("--stage", default="scratch", choices=list(generation.STAGES))
    run.add_argument("--drop-scope", default="row", choices=["row", "base_topic"])
    run.add_argument("--disable-judge", action="store_true")
    run.add_argument("--disable-metrics", action="store_true")
    run.add_argument("--seed", type=int, default=0)
    run.add_argument("--attempt", type=int, default=0)
    run.add_argument("--yes-id", type=int, help="token of 'yes'; by default the client tells it")
    run.add_argument("--partitions", type=int, help="most model calls at a time")
    run.add_argument("--csv", help="also export the last table as CSV, metrics as JSON")
    div = commands.add_parser("diversity")
    div.add_argument("--client", required=True)
    div.add_argument("--folder", required=True)
    div.add_argument("--report", required=True)
    div.add_argument("--run-id", required=True)
    sets = commands.add_parser("training-sets")
    sets.add_argument("--synthetic", required=True, help="table with dialogue_id or id, dialogue and summary")
    sets.add_argument("--corpus", required=True, help="exported train split (parquet) with id, dialogue, summary")
    sets.add_argument("--test", required=True, help="CSV with id, dialogue, summary")
    sets.add_argument("--kind", default="response", choices=["response", "summary"])
    sets.add_argument("--seed", type=int, default=datasets.SEED)
    sets.add_argument("--out", required=True)
    predict = commands.add_parser("predict")
    predict.add_argument("--kind", default="response", choices=list(KINDS))
    for name in ("--client", "--test", "--run-id", "--out"):
        predict.add_argument(name, required=True)
    for command in ("score-summaries", "score-responses"):
        score = commands.add_parser(command)
        for name in ("--client", "--predictions", "--test", "--report"):
            score.add_argument(name, required=True)
    file = commands.add_parser("score-file")
    for name in ("--client", "--csv", "--run-id", "--report"):
        file.add_argument(name, required=True)
    return parser.parse_args(argv)


# What a model is shown, its settings, and the column of its answer.
KINDS = {
    "summary": ("dialogue", prompts.PREDICT_SUMMARY_PARAMS, "predicted_summary"),
    "response": ("context", prompts.PREDICT_RESPONSE_PARAMS, "predicted_response"),
}


def training_sets(spark: SparkSession, args: argparse.Namespace) -> None:
    synthetic = spark.read.parquet(args.synthetic)
    if "id" not in synthetic.columns:
        synthetic = synthetic.withColumnRenamed("dialogue_id", "id")
    if "summary" not in synthetic.columns:
        synthetic = synthetic.withColumn("summary", F.lit(None).cast("string"))
    columns = ["id", "dialogue", "summary"]
    tables.save_stage(datasets.training_sets(
        synthetic.select(columns), files.read_corpus_split(spark, args.corpus),
        files.read_test_set(spark, args.test).select(columns), args.kind, args.seed,
    ), args.out)


def predict(spark: SparkSession, args: argparse.Namespace) -> None:
    shown, params, out = KINDS[args.kind]
    test = files.read_test_set(spark, args.test)
    rows = datasets.response_pairs(test) if args.kind == "response" else test
    found = scoring.predict(rows, shown, load_client(args.client), params, args.run_id, out, f"{args.out}-responses")
    found.write.mode("append").parquet(args.out)


def score_runs(spark: SparkSession, args: argparse.Namespace) -> None:
    client, test = load_client(args.client), files.read_test_set(spark, args.test)
    predictions = spark.read.parquet(args.predictions)
    if args.command == "score-summaries":
        rows = scoring.compare_summaries(predictions, test, client)
    else:
        rows = scoring.compare_runs(predictions, datasets.response_pairs(test), client)
    tables.append_report(rows, args.report)


def score_file(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = files.read_csv(spark, args.csv, PREDICTION_CSV)
    scores = scoring.score_prediction_file(rows, load_client(args.client))
    tables.append_report(scores.select(F.lit(args.run_id).alias("run_id"), "*"), args.report)


COMMANDS = {
    "training-sets": training_sets, "predict": predict, "score-summaries": score_runs, "score-responses": score_runs,
    "score-file": score_file,
}


def main(argv: list[str] | None = None) -> None:
    args = arguments(argv)
    spark = build_session()
    if args.command in COMMANDS:
        COMMANDS[args.command](spark, args)
        return
    client = load_client(args.client)
    if args.command == "diversity":
        corpus.diversity_report(spark, args.folder, client, args.report, args.run_id)
        return
    run = generation.Run(
        spark, args.out, client, args.n_sub_topics, args.n_personas, args.stage, args.disable_judge,
        args.disable_metrics, args.drop_scope, args.seed, args.attempt, args.partitions, args.yes_id,
    )
    out = generation.execute(
        run,
        files.read_topics(spark, args.topics) if args.topics else None,
        files.read_seed_dialogues(spark, args.seeds) if args.seeds else None,
        spark.read.parquet(args.dialogues) if args.dialogues else None,
    )
    if args.csv:
        # Maps of metrics as JSON, which is how a cell can hold them.
        flat = [F.to_json(c).alias(c) if kind.startswith("map") else F.col(c) for c, kind in out.dtypes]
        tables.export_csv(out.select(*flat), args.csv)


if __name__ == "__main__":
    main()
