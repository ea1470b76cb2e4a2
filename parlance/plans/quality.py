"""Model-scored dialogue quality: FED, GPTScore, G-Eval, and their registry.

A family asks all its criteria in one request per dialogue: the text reaches a
task once, the requests of the criteria are written out there, and one array of
numbers comes back, which goes to the score ledger. Metrics are folded from that
array inside the row, so nothing is shuffled by dialogue and criterion.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.prompts import (
    DEFAULT, FOLLOWUPS, PROBED_ASPECTS, RATED_ASPECTS, Templates, probe_messages, rubric_messages,
)
from parlance.functions.text import followup_lead
from parlance.operators import model
from parlance.operators.model import Client, ClientFactory, each_or_batch
from parlance.operators.reports import metric_maps
from parlance.session import materialize

# dialogues (dialogue_id, dialogue) -> a row per dialogue (dialogue_id, metrics,
# error) or a row per metric (dialogue_id, metric, value)
Family = Callable[[DataFrame], DataFrame]
# Entries of one client call.
CALL = 64


def criteria(fields: list[str], rows: list[tuple]) -> Column:
    """A fixed table as one array of structs."""
    return F.array(*[F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, row)]) for row in rows])


def followup_criteria() -> Column:
    return criteria(
        ["metric", "polarity", "utterance"],
        [
            (metric, polarity, utterance)
            for metric, sides in FOLLOWUPS.items()
            for polarity in ("positive", "negative")
            for utterance in sides[polarity]
        ],
    )


def with_criteria(dialogues: DataFrame, table: Column) -> DataFrame:
    return dialogues.select("*", F.inline(table))


@dataclass(frozen=True)
class Scale:
    """What a family asks of each dialogue, and how its metrics follow from the numbers.

    ``ask`` gives a dialogue's requests, one per criterion; ``answer`` their
    numbers and errors; ``fold`` the values of ``metrics`` from the column of
    numbers, where a missing number is null.
    """

    name: str
    metrics: tuple[str, ...]
    ask: Callable[[str, str], list]
    answer: Callable[[Client, list], tuple[list, list]]
    fold: Callable[[Column], list[Column]]
    settings: str = ""

    def measure(self, client: Client, rows: list[dict]) -> tuple[list, list]:
        """Array of numbers of each dialogue, and its first error."""
        asked = [[] if r["dialogue"] is None else self.ask(r["dialogue"], r["lead"]) for r in rows]
        flat = [request for requests in asked for request in requests]
        numbers, errors = [], []
        for lo in range(0, len(flat), CALL):
            got, failed = self.answer(client, flat[lo : lo + CALL])
            numbers += got
            errors += failed
        values, first, at = [], [], 0
        for requests in asked:
            to = at + len(requests)
            values.append([None if v is None else float(v) for v in numbers[at:to]] if requests else None)
            first.append(next((e for e in errors[at:to] if e), None))
            at = to
        return values, first


def score(dialogues: DataFrame, scale: Scale, client: ClientFactory, store: str | None = None) -> DataFrame:
    """dialogue_id, metrics (map of metric to value), error: a row per dialogue.

    A metric whose numbers are not all there is null; a null dialogue has no
    metrics and no error.
    """
    # The speaker is found once per dialogue.
    inputs = {"dialogue": F.col("dialogue"), "lead": followup_lead(F.col("dialogue"))}
    rows = model.measured(
        dialogues.select("dialogue_id", "dialogue"), f"score/{scale.name}", ["dialogue_id"], inputs, client,
        scale.measure, "array<double>", scale.settings, store,
    )
    names = F.array(*[F.lit(m) for m in scale.metrics])
    found = F.map_from_arrays(names, F.array(*scale.fold(F.col("value"))))
    return rows.select("dialogue_id", F.when(F.col("value").isNotNull(), found).alias("metrics"), "error")


def long_rows(scores: DataFrame) -> DataFrame:
    """dialogue_id, metric, value: a row per metric."""
    return scores.select("dialogue_id", F.explode("metrics").alias("metric", "value"))


def fed_scale() -> Scale:
    """Mean loss of the negative follow-ups less that of the positive ones; an empty side counts 0."""
    utterances = [u for sides in FOLLOWUPS.values() for p in ("positive", "negative") for u in sides[p]]

    def fold(losses: Column) -> list[Column]:
        out, at = [], 0
        for sides in FOLLOWUPS.values():
            mean = {}
            for polarity in ("positive", "negative"):
                n = len(sides[polarity])
                total = F.lit(0.0)
                for i in range(at, at + n):
                    total = total + F.get(losses, F.lit(i))
                mean[polarity], at = total / F.lit(float(max(n, 1))), at + n
            out.append(mean["negative"] - mean["positive"])
        return out

    return Scale(
        "fed", tuple(FOLLOWUPS), lambda dialogue, lead: [dialogue + lead + u for u in utterances],
        lambda client, texts: each_or_batch(client.loss, texts), fold, repr(utterances),
    )


def before_last(tokens: list[int], wanted: int) -> int | None:
    """Place just before the last ``wanted`` token; None when it is missing or stands first."""
    places = np.flatnonzero(np.asarray(tokens) == wanted)
    return int(places[-1]) - 1 if len(places) and places[-1] > 0 else None


def softmax(logits: list[float]) -> np.ndarray:
    weights = np.exp(np.asarray(logits, dtype="float64") - max(logits))
    return weights / weights.sum()


def probe_scale(
    yes_id: int | None = None, aspects: dict[str, str] = PROBED_ASPECTS, templates: Templates = DEFAULT
) -> Scale:
    """Probability of the token 'yes' where the forced answer has it; the client tells the token unless it is given."""

    def answer(client: Client, messages: list) -> tuple[list, list]:
        yes = client.yes_id() if yes_id is None else yes_id
        tokens, errors = each_or_batch(client.tokenize, messages)
        numbers: list = [None] * len(messages)
        spots = [None if t is None else before_last(t, yes) for t in tokens]
        some = [i for i, p in enumerate(spots) if p is not None]
        call = lambda b: client.logits_at([t for t, _ in b], [p for _, p in b])
        logits, failed = each_or_batch(call, [(tokens[i], spots[i]) for i in some])
        for i, row, error in zip(some, logits, failed):
            errors[i] = errors[i] or error
            if row is not None:
                numbers[i] = softmax(row)[yes]
        return numbers, errors

    return Scale(
        "gpt_score", tuple(aspects), lambda dialogue, _: [probe_messages(q, dialogue, templates) for q in aspects.values()],
        answer, lambda values: [F.get(values, F.lit(i)) for i in range(len(aspects))], repr((yes_id, aspects, templates)),
    )


def rubric_scale(aspects: dict[str, str] = RATED_ASPECTS, templates: Templates = DEFAULT) -> Scale:
    """Expected rating of 1 to 3 from the logits of the three digits."""

    def answer(client: Client, messages: list) -> tuple[list, list]:
        logits, errors = each_or_batch(client.rating_logits, messages)
        rate = lambda row: float(softmax(row) @ np.arange(1, len(row) + 1))
        return [None if row is None else rate(row) for row in logits], errors

    return Scale(
        "g_eval", tuple(aspects), lambda dialogue, _: [rubric_messages(a, dialogue, templates) for a in aspects.values()],
        answer, lambda values: [F.get(values, F.lit(i)) for i in range(len(aspects))], repr((aspects, templates)),
    )


def fed(dialogues: DataFrame, client: ClientFactory, store: str | None = None) -> DataFrame:
    """dialogue_id, metric, value."""
    return long_rows(score(dialogues, fed_scale(), client, store))


def gpt_score(
    dialogues: DataFrame, client: ClientFactory, yes_id: int | None = None,
    aspects: dict[str, str] = PROBED_ASPECTS, templates: Templates = DEFAULT, store: str | None = None,
) -> DataFrame:
    """dialogue_id, metric, value."""
    return long_rows(score(dialogues, probe_scale(yes_id, aspects, templates), client, store))


def g_eval(
    dialogues: DataFrame, client: ClientFactory,
    aspects: dict[str, str] = RATED_ASPECTS, templates: Templates = DEFAULT, store: str | None = None,
) -> DataFrame:
    """dialogue_id, metric, value."""
    return long_rows(score(dialogues, rubric_scale(aspects, templates), client, store))


def families(client: ClientFactory, yes_id: int | None = None, store: str | None = None) -> dict[str, Family]:
    """The three families; with ``store``, a folder, each keeps a ledger there and resumes from it."""
    scales = [fed_scale(), probe_scale(yes_id), rubric_scale()]
    at = lambda scale: f"{store}/{scale.name}" if store else None
    return {s.name: (lambda d, s=s: score(d, s, client, at(s))) for s in scales}


def metric_tables(dialogues: DataFrame, registry: dict[str, Family]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Per family a table of dialogue_id, metrics, error; and the error of each family that failed as a whole.

    Every family is written on its own, so one that fails leaves the others.
    """
    done, errors = {}, {}
    for name, family in registry.items():
        try:
            rows = family(dialogues)
            if "metrics" not in rows.columns:
                rows = metric_maps(rows, ["dialogue_id"]).withColumn("error", F.lit(None).cast("string"))
            done[name] = materialize(rows.select("dialogue_id", "metrics", "error"), name)
        except Exception as exc:  # noqa: BLE001 - reported to the caller
            errors[name] = f"{type(exc).__name__}: {exc}"
    return done, errors


def _stacked(tables: dict[str, DataFrame], rows: Callable[[DataFrame], DataFrame], empty: DataFrame) -> DataFrame:
    out = empty
    for name, table in tables.items():
        out = out.unionByName(rows(table).withColumn("family", F.lit(name)))
    return out


def metric_rows(dialogues: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """dialogue_id, family, metric, value."""
    empty = dialogues.select("dialogue_id", *[F.lit("").alias(c) for c in ("family", "metric")], F.lit(0.0).alias("value"))
    return _stacked(tables, long_rows, empty.limit(0))


def metric_errors(dialogues: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """dialogue_id, family, error of every dialogue that a family could not score wholly."""
    empty = dialogues.select("dialogue_id", *[F.lit("").alias(c) for c in ("family", "error")]).limit(0)
    return _stacked(tables, lambda t: t.where(F.col("error").isNotNull()).select("dialogue_id", "error"), empty)


def calculate_metrics(dialogues: DataFrame, registry: dict[str, Family]) -> tuple[DataFrame, dict[str, str]]:
    """Long table dialogue_id, family, metric, value, and the error of each failed family."""
    tables, errors = metric_tables(dialogues, registry)
    return metric_rows(dialogues, tables), errors


def attach_metrics(dialogues: DataFrame, tables: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """One map column per family; null where the family failed."""
    for name in names:
        if name in tables:
            own = tables[name].select("dialogue_id", F.col("metrics").alias(name))
            dialogues = dialogues.join(own, "dialogue_id", "left")
        else:
            dialogues = dialogues.withColumn(name, F.lit(None).cast("map<string,double>"))
    return dialogues
