"""Quality classifier by positive-unlabelled learning.

Trusted positives are training rows labelled 1; the unlabelled web text is a
sample of all training documents, whatever their label. A linear model on
hashed byte trigrams minimises the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

with the sigmoid loss; where the second part falls below zero, its gradient is
reversed, as the method says. The class prior is estimated from the labels: the
share of 1 among the labelled training rows. The score's offset is set so that
the mean score of the unlabelled sample is the prior.

Fitted on at most ``POSITIVES`` + ``UNLABELLED`` rows, chosen by a hash of the
id; every document is scored, by its whole text.

Defined results: a null text is scored as the empty one. Without a trusted
positive every score is the prior, or 0.5 without any label. A document with
several labels counts with the largest. Rows with null ids are scored, have
held_out false and are not learnt from. Repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import fold, packed, prepare, share, slices, thinned, trigrams

POSITIVES, UNLABELLED = 8_000, 12_000
DIMS, EPOCHS, BATCH, STEP, DECAY = 1024, 40, 512, 0.02, 1e-4
FOLDS, THRESHOLD = 5, 0.3


def features(texts: list[bytes]) -> np.ndarray:
    """Root frequencies of hashed trigrams and a few measures of shape."""
    counts = trigrams(texts, DIMS)
    total = counts.sum(1, keepdims=True)
    freq = counts / np.maximum(total, 1)
    seen = (counts > 0).sum(1) / np.maximum(np.minimum(total[:, 0], DIMS), 1)
    size = np.log1p([len(t) for t in texts])
    shape = np.stack([size / 10, seen, np.sqrt(freq.max(1)), (total[:, 0] == 0)], 1)
    return np.hstack([np.sqrt(freq), shape]).astype(np.float32)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and offset with the least non-negative risk.

    The samples stay as they are; only the rows of a step are widened and scaled.
    """
    columns = (unlabelled[:, start:end].astype(np.float32) for start, end in slices(unlabelled.shape[1], 64))
    mean, scale = (np.concatenate(x) for x in zip(*[(c.mean(0), c.std(0) + np.float32(0.01)) for c in columns]))
    wide = lambda rows: (rows.astype(np.float32) - mean) / scale
    rng = np.random.default_rng(seed)
    w, b = np.zeros(positive.shape[1]), 0.0
    first, second, t = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0
    loss = lambda z: 1 / (1 + np.exp(np.clip(z, -30, 30)))  # noqa: E731  sigmoid loss of margin z
    for _ in range(EPOCHS):
        order = rng.permutation(len(unlabelled))
        for start, end in slices(len(unlabelled), BATCH):
            xu = wide(unlabelled[order[start:end]])
            xp = wide(positive[rng.integers(0, len(positive), BATCH)])
            zu, zp = xu @ w + b, xp @ w + b
            negative = loss(-zu).mean() - prior * loss(-zp).mean()
            slope_u, slope_p = loss(zu) * loss(-zu), loss(zp) * loss(-zp)
            # Gradients of R-(u) - prior R-(p) and of prior R+(p) with respect to the margins.
            down_u, down_p, up_p = slope_u / len(xu), -prior * slope_p / len(xp), -prior * slope_p / len(xp)
            if negative < 0:
                gu, gp = -down_u, -down_p
            else:
                gu, gp = down_u, down_p + up_p
            g = np.append(gu @ xu + gp @ xp + DECAY * w, gu.sum() + gp.sum())
            t += 1
            first = 0.9 * first + 0.1 * g
            second = 0.999 * second + 0.001 * g * g
            move = STEP * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
    # The offset at which the unlabelled rows' mean score is the prior.
    z = np.concatenate([wide(unlabelled[start:end]) @ w for start, end in slices(len(unlabelled), BATCH)])
    low, high = -50.0, 50.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (1 - loss(z + middle)).mean() < prior else (low, middle)
    return w / scale, low - float((mean / scale) @ w)


def score_texts(texts: list[bytes], w: np.ndarray, b: float) -> np.ndarray:
    out = np.empty(len(texts))
    for start, end in slices(len(texts), 512):
        out[start:end] = 1 / (1 + np.exp(-np.clip(features(texts[start:end]) @ w + b, -30, 30)))
    return out


def _gathered(rows: DataFrame, most: int) -> np.ndarray:
    """Features, as half floats, of at most ``most`` rows. The texts stay in their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            # A batch may hold thousands of short texts, whose rows of features take far more than the texts.
            for start, end in slices(len(texts), 512):
                found = features(texts[start:end]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in found], pa.binary())], ["x"])

    found = rows.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "x binary").limit(most).toArrow()
    out = np.zeros((found.num_rows, DIMS + 4), np.float16)
    at = 0
    for chunk in found.column("x").chunks:
        for x in chunk:
            out[at] = np.frombuffer(x.as_buffer(), np.float16)
            at += 1
    # Rows arrive in any order; training takes them in one of their own.
    return out[np.argsort([xxhash.xxh64_intdigest(x.tobytes()) for x in out], kind="stable")] if len(out) else out


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray | None, float]:
    """Weights and offset of the classifier, from the training folds of ``labels``."""
    prepare(docs.sparkSession)
    learn = fold(F.col("doc_id"), FOLDS) != 0
    known = labels.where(F.col(label).isNotNull() & learn).groupBy("doc_id").agg(F.max(label).alias("label"))
    sums = known.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).head()
    n, ones = sums["n"], sums["ones"] or 0
    prior = ones / n if n else 0.5
    if not ones:
        return None, prior
    prior = min(max(prior, 0.01), 0.99)
    corpus = docs.where(learn).select("doc_id", "text")
    trusted = thinned(known.where("label = 1"), F.col("doc_id"), POSITIVES, int(ones)).select("doc_id")
    positive = _gathered(corpus.join(F.broadcast(trusted), "doc_id"), POSITIVES)
    some = share(F.concat(F.lit("u"), F.col("doc_id")), UNLABELLED, corpus.select("doc_id").count())
    unlabelled = _gathered(corpus.where(some), UNLABELLED)
    if not len(positive) or not len(unlabelled):
        return None, prior
    return fit(positive, unlabelled, prior)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """_row (all columns of ``docs``), held_out, score, predicted of every document."""
    w, b = train(docs, labels)
    held = F.coalesce(fold(docs["doc_id"], FOLDS) == 0, F.lit(False))
    rows = packed(docs, F.coalesce(docs["text"], F.lit("")).alias("_text"), held.alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            score = score_texts(texts, w, b) if w is not None else np.full(len(texts), b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score)], ["_row", "held_out", "score"])

    shape = T.StructType([
        rows.schema["_row"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()),
    ])
    return rows.mapInArrow(run, shape).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject; all columns stay."""
    return classify(docs, labels, threshold).where("predicted = 1").select("_row.*")
