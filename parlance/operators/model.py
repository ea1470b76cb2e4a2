"""Batch model jobs: a request table in, a response table out.

The model is injected. Spark partitions and batches the requests, isolates
failures to their row, writes the answers before anything reads them, and on
a rerun asks only what is missing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from parlance.functions.prompts import Params
from parlance.functions.vectors import MATCH, match_rows
from parlance.schemas import RESPONSE
from parlance.session import scratch_path
from parlance.sources.ledger import Ledger, request_key


class Client(Protocol):
    """What a model backend offers. Only the used methods are needed.

    Every method but ``yes_id`` takes a batch and returns one result per entry,
    in order. ``identity``, where a client has it, names the model whose stored
    answers it may reuse; without it they are kept by the name of the class.
    """

    def generate(self, batch: list[list[dict]], params: Params) -> list[str]: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def token_vectors(self, texts: list[str]) -> list[list[list[float]]]: ...

    def loss(self, texts: list[str]) -> list[float]: ...

    def tokenize(self, batch: list[list[dict]]) -> list[list[int]]: ...

    def yes_id(self) -> int: ...

    def logits_at(self, tokens: list[list[int]], positions: list[int]) -> list[list[float]]: ...

    def rating_logits(self, batch: list[list[dict]]) -> list[list[float]]: ...


# Called once per Python worker task, so a model is loaded there and only there.
ClientFactory = Callable[[], Client]


def each_or_batch(call: Callable[[list], list], batch: list) -> tuple[list, list]:
    """Results and errors of a batch; entries are tried one by one if it fails."""
    if not batch:
        return [], []
    try:
        results = list(call(batch))
        if len(results) == len(batch):
            return results, [None] * len(batch)
    except Exception:  # noqa: BLE001 - any client error is isolated below
        pass
    results, errors = [], []
    for entry in batch:
        try:
            results.append(list(call([entry]))[0])
            errors.append(None)
        except Exception as exc:  # noqa: BLE001
            results.append(None)
            errors.append(f"{type(exc).__name__}: {exc}")
    return results, errors


def run_requests(
    requests: DataFrame,
    client: ClientFactory,
    params: Params,
    store: str | None = None,
    partitions: int | None = None,
    batch_size: int = 16,
) -> DataFrame:
    """Store of request_id, response, error after answering request_id, messages.

    ``partitions`` bounds the number of concurrent model calls.
    """
    spark = requests.sparkSession
    asked = requests.select("request_id", "messages")

    def answer(todo: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = None
            for pdf in batches:
                for lo in range(0, len(pdf), batch_size):
                    part = pdf.iloc[lo : lo + batch_size]
                    model = model or client()
                    messages = [[dict(m) for m in ms] for ms in part["messages"]]
                    texts, errors = each_or_batch(lambda b: model.generate(b, params), messages)
                    yield pd.DataFrame(
                        {"request_id": part["request_id"].to_numpy(), "response": texts, "error": errors}
                    )

        spread = todo.repartition(partitions, "request_id") if partitions else todo
        return spread.mapInPandas(run, RESPONSE)

    where = store or scratch_path(spark, "responses")
    return Ledger(spark, where, "string", "response").fill(asked, answer)


def generate(
    df: DataFrame,
    stage: str,
    key: list[str],
    messages: Column,
    client: ClientFactory,
    params: Params,
    store: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """``df`` with ``response`` and ``error``; ``key`` identifies its rows."""
    request = request_key(client, stage, params.key(), *key, messages.alias("messages"))
    keyed = df.withColumn("request_id", request)
    answers = run_requests(keyed.select("request_id", messages.alias("messages")), client, params, store, partitions)
    return keyed.join(answers, "request_id").drop("request_id")


# (client, rows of the inputs) -> one value and one error per row
Measure = Callable[[Client, list[dict]], tuple[list, list]]


def measured(
    df: DataFrame,
    stage: str,
    key: list[str],
    inputs: dict[str, Column],
    client: ClientFactory,
    measure: Measure,
    returns: str,
    settings: str = "",
    store: str | None = None,
    partitions: int | None = None,
    batch_size: int = 16,
) -> DataFrame:
    """key, value, error: a score or vector of every row, by ``measure`` over ``inputs``.

    Results go to the ledger at ``store`` and are asked for once. ``measure``
    isolates failures to their row (or to parts of a row's value).
    """
    spark = df.sparkSession
    columns = [c.alias(n) for n, c in inputs.items()]
    ids = request_key(client, stage, settings, *key, *columns)
    asked = df.select(ids.alias("request_id"), *columns)
    ledger = Ledger(spark, store or scratch_path(spark, "scores"), returns)
    # The ledger's schema as Arrow sees it, so that missing values and parts stay missing.
    shape = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in ledger.schema])

    def answer(todo: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = None
            for batch in batches:
                for lo in range(0, batch.num_rows, batch_size):
                    part = batch.slice(lo, batch_size).to_pylist()
                    model = model or client()
                    values, errors = measure(model, part)
                    names = [r["request_id"] for r in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, f.type) for x, f in zip((names, values, errors), shape)], schema=shape
                    )

        spread = todo.repartition(partitions, "request_id") if partitions else todo
        return spread.mapInArrow(run, ledger.schema)

    results = ledger.fill(asked, answer)
    return df.select(*key, ids.alias("request_id")).join(results, "request_id").drop("request_id")


def embeddings(
    df: DataFrame, key: list[str], text: Column, client: ClientFactory, store: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """key, value (array<float>), error: the vector of every text; null for a null text."""

    def measure(model: Client, rows: list[dict]) -> tuple[list, list]:
        values, errors = [None] * len(rows), [None] * len(rows)
        some = [i for i, r in enumerate(rows) if r["text"] is not None]
        for i, value, error in zip(some, *each_or_batch(model.embed, [rows[i]["text"] for i in some])):
            values[i], errors[i] = None if value is None else list(value), error
        return values, errors

    return measured(df, "embed", key, {"text": text}, client, measure, "array<float>", "", store, partitions)


def token_match(predicted: Column, reference: Column, client: ClientFactory, batch_size: int = 16) -> Column:
    """struct(precision, recall, f1) of two texts over the client's token vectors; nulls for a null or failed side.

    A text's vectors take many times its own bytes, so they are matched where
    they are made, ``batch_size`` rows at a time, and not sent to another step.
    """

    @F.pandas_udf(MATCH)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = None
        for sides in batches:
            model = model or client()
            found = [match_rows([], [])]
            for lo in range(0, len(sides[0]), batch_size):
                found.append(match_rows(*[_vectors(model, s.iloc[lo : lo + batch_size].tolist()) for s in sides]))
            yield pd.concat(found, ignore_index=True)

    return run(predicted, reference)


def _vectors(model: Client, texts: list[str | None]) -> list:
    """Single-precision token vectors of each text; None for a missing text or a failed call."""
    out: list = [None] * len(texts)
    rows = [i for i, t in enumerate(texts) if t is not None]
    for i, value in zip(rows, each_or_batch(model.token_vectors, [texts[i] for i in rows])[0]):
        out[i] = None if value is None else [np.asarray(v, np.float32) for v in value]
    return out
