"""Scores of predicted summaries and responses, and question-answer agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.parsing import parse_list
from parlance.functions.prompts import (
    ANSWER_PARAMS, DEFAULT, QUESTION_PARAMS, Params, Templates, answer_request, question_request,
)
from parlance.functions.rouge import rouge_l
from parlance.operators import model
from parlance.operators.lists import zip_answers
from parlance.operators.model import ClientFactory
from parlance.operators.reports import long_metrics, mean_by_document, report
from parlance.operators.sampling import chunked_mean
from parlance.session import materialize


def bert_score(predicted: Column, reference: Column, client: ClientFactory) -> Column:
    """struct(precision, recall, f1) over token vectors of both texts."""
    return model.token_match(predicted, reference, client)


def predict(
    rows: DataFrame, text: str, client: ClientFactory, params: Params, run_id: str, out: str,
    store: str | None = None,
) -> DataFrame:
    """run_id, id, prediction of a trained model for each input row.

    Predictions of several runs stand side by side in one table.
    """
    messages = F.array(F.struct(F.lit("user").alias("role"), F.col(text).alias("content")))
    answers = model.generate(
        rows.select("id", text), f"predict/{run_id}", ["id"], messages, client, params, store
    )
    return answers.select(F.lit(run_id).alias("run_id"), "id", F.col("response").alias(out), "error")


def ask_questions(
    rows: DataFrame, client: ClientFactory, n: int = 3, store: str | None = None, templates: Templates = DEFAULT
) -> DataFrame:
    """id, questions; unreadable answers leave their id out."""
    asked = model.generate(
        rows.select("id", "dialogue"), "questions", ["id"],
        question_request(F.col("dialogue"), n, templates), client, QUESTION_PARAMS, store,
    )
    return asked.select("id", parse_list(F.col("response"))["items"].alias("questions")).where(
        F.col("questions").isNotNull()
    )


def answer_questions(
    rows: DataFrame, passage: str, client: ClientFactory, out: str, store: str | None = None,
    templates: Templates = DEFAULT,
) -> DataFrame:
    """id, ``out``: the answer list, null when it cannot be read."""
    asked = model.generate(
        rows.select("id", passage, "questions"), f"answers/{passage}", ["id"],
        answer_request(F.col(passage), F.col("questions"), templates), client, ANSWER_PARAMS, store,
    )
    return asked.select("id", parse_list(F.col("response"))["items"].alias(out))


def qa_rows(
    rows: DataFrame, client: ClientFactory, n: int = 3, store: str | None = None, templates: Templates = DEFAULT
) -> DataFrame:
    """id, questions, answers_from_dialogue, answers_from_summary.

    ``rows`` has id, dialogue, predicted_summary. Rows without questions are
    skipped by the inner join.
    """
    questions = materialize(ask_questions(rows, client, n, store, templates), "questions")
    # Written once: the requests and their keys are both made from it, with no further shuffle of the texts.
    asked = materialize(rows.select("id", "dialogue", "predicted_summary").join(questions, "id"), "asked", "zstd")
    from_dialogue = answer_questions(asked, "dialogue", client, "answers_from_dialogue", store, templates)
    from_summary = answer_questions(asked, "predicted_summary", client, "answers_from_summary", store, templates)
    return questions.join(from_dialogue, "id").join(from_summary, "id")


def qags_scores(qas: DataFrame, client: ClientFactory) -> DataFrame:
    """id, pos, score: agreement of the two answers to each question."""
    pairs = zip_answers(qas, "answers_from_dialogue", "answers_from_summary", ["id"])
    f1 = bert_score(F.col("answers_from_summary"), F.col("answers_from_dialogue"), client)["f1"]
    return pairs.select("id", "pos", f1.alias("score"))


def qags(qas: DataFrame, client: ClientFactory) -> DataFrame:
    """id, mean over the questions of the document."""
    return mean_by_document(qags_scores(qas, client), "id", "score")


def qags_chunked(qas: DataFrame, order: str, client: ClientFactory, n: int = 3) -> DataFrame:
    """chunk, mean with the score list cut every ``n`` items in document order.

    Kept for comparison: chunks stop matching documents as soon as one of them
    has other than ``n`` questions.
    """
    pairs = zip_answers(qas, "answers_from_dialogue", "answers_from_summary", [order])
    f1 = bert_score(F.col("answers_from_summary"), F.col("answers_from_dialogue"), client)["f1"]
    scored = materialize(pairs.select(order, "pos", f1.alias("score")), "qa-scores")
    width = scored.agg(F.coalesce(F.max("pos"), F.lit(0)) + 1).head()[0]
    flat = scored.select((F.col(order) * F.lit(width) + F.col("pos")).alias("at"), "score")
    return chunked_mean(flat, "at", "score", n)


def score_texts(
    rows: DataFrame, keys: list[str], predicted: str, reference: str, client: ClientFactory | None, stem: bool
) -> DataFrame:
    """keys, rouge_l and, with a client, bert_score of each prediction."""
    columns = [rouge_l(F.col(reference), F.col(predicted), stem).alias("rouge_l")]
    if client is not None:
        columns.append(bert_score(F.col(predicted), F.col(reference), client)["f1"].alias("bert_score"))
    return rows.select(*keys, *columns)


def join_predictions(predictions: DataFrame, references: DataFrame, columns: list[str]) -> DataFrame:
    """Predictions of all runs with their reference row, by id."""
    return predictions.join(references.select("id", *columns), "id")


def score_summaries(
    rows: DataFrame, client: ClientFactory, store: str | None = None, n: int = 3
) -> DataFrame:
    """id, metric, value of qags, bert_score and rouge_l.

    ``rows``: id, dialogue, summary, predicted_summary.
    """
    texts = score_texts(rows, ["id"], "predicted_summary", "summary", client, stem=False)
    agreement = qags(materialize(qa_rows(rows, client, n, store), "qas"), client)
    return long_metrics(texts, ["id"], ["rouge_l", "bert_score"]).unionByName(
        agreement.select("id", F.lit("qags").alias("metric"), F.col("mean").alias("value"))
    )


def run_qa_rows(
    predictions: DataFrame, references: DataFrame, client: ClientFactory, n: int = 3, store: str | None = None,
    templates: Templates = DEFAULT,
) -> DataFrame:
    """run_id, id and the answers of ``qa_rows`` for the predictions of several runs.

    The questions, and the answers from the dialogue, are asked once for all runs.
    """
    questions = materialize(ask_questions(references, client, n, store, templates), "questions")
    asked = materialize(references.select("id", "dialogue").join(questions, "id"), "asked", "zstd")
    from_dialogue = materialize(answer_questions(asked, "dialogue", client, "answers_from_dialogue", store, templates), "answers")
    # A prediction's key is its run and id.
    own = F.struct("run_id", "id")
    predicted = predictions.select("run_id", "id", "predicted_summary").join(questions, "id").withColumn("id", own)
    predicted = materialize(predicted, "predicted", "zstd")
    from_summary = answer_questions(predicted, "predicted_summary", client, "answers_from_summary", store, templates)
    from_summary = from_summary.select("id.run_id", "id.id", "answers_from_summary")
    return from_summary.join(from_dialogue, "id")


def compare_summaries(
    predictions: DataFrame, references: DataFrame, client: ClientFactory, n: int = 3, store: str | None = None
) -> DataFrame:
    """run_id, metric, mean, scored, missing of qags, bert_score and rouge_l, for the summaries that several runs predicted.

    ``predictions``: run_id, id, predicted_summary; ``references``: id, dialogue, summary.
    """
    rows = join_predictions(predictions, references, ["summary"])
    texts = score_texts(rows, ["run_id", "id"], "predicted_summary", "summary", client, stem=False)
    qas = materialize(run_qa_rows(predictions, references, client, n, store), "qas")
    pairs = zip_answers(qas, "answers_from_dialogue", "answers_from_summary", ["run_id", "id"])
    f1 = bert_score(F.col("answers_from_summary"), F.col("answers_from_dialogue"), client)["f1"]
    agreement = pairs.select("run_id", "id", f1.alias("score")).groupBy("run_id", "id").agg(F.avg("score").alias("value"))
    scores = long_metrics(texts, ["run_id", "id"], ["rouge_l", "bert_score"]).unionByName(
        agreement.select("run_id", "id", F.lit("qags").alias("metric"), "value")
    )
    return report(scores, ["run_id"])


def score_responses(rows: DataFrame, keys: list[str], client: ClientFactory | None = None) -> DataFrame:
    """keys, rouge_l (stemmed), bert_score of response and predicted_response."""
    return score_texts(rows, keys, "predicted_response", "response", client, stem=True)


def compare_runs(predictions: DataFrame, references: DataFrame, client: ClientFactory | None = None) -> DataFrame:
    """run_id, metric, mean of every run's predictions on one test set."""
    rows = join_predictions(predictions, references, ["response"])
    scored = score_responses(rows, ["run_id", "id"], client)
    metrics = [c for c in ("rouge_l", "bert_score") if c in scored.columns]
    return report(long_metrics(scored, ["run_id", "id"], metrics), ["run_id"])


def score_prediction_file(rows: DataFrame, client: ClientFactory) -> DataFrame:
    """metric, mean over a table of dialogue, predicted_summary, summary."""
    scored = score_texts(rows, [], "predicted_summary", "summary", client, stem=False)
    return report(long_metrics(scored, [], ["rouge_l", "bert_score"]), [])


