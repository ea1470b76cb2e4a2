"""Language identification by hierarchical discrimination.

First a linear classifier picks the language family; then, within the family,
linear support vector machines that separate two languages each vote for the
language (ties go to the larger summed margin). All work on root frequencies of
hashed byte trigrams, lower-cased in ASCII. ``FAMILIES`` gives the family of a
language code; a code outside it is a family of its own.

Fitted on at most ``SAMPLE`` rows in all, shared out evenly among the languages
and chosen by a hash of the id; every document is judged by its whole text.

Defined results: a null text, or one without a letter, is ``und`` with score
1. Where no language can be learnt all are ``und`` with score 0. A null id is
neither learnt from nor held out. Repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import fold, prepare, slices, trigrams

SAMPLE, DIMS, FOLDS = 12_000, 2048, 3
MOST_LANGUAGES = 1_000

# Families of common language codes.
FAMILIES = {
    "germanic": "af da de en fy is lb nl no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "semitic": "am ar he mt",
    "iranian": "fa ku ps tg",
    "indic": "bn gu hi mr ne pa si ur",
    "dravidian": "kn ml ta te",
    "sinitic": "zh yue",
}


def family(code: str) -> str:
    return next((name for name, codes in FAMILIES.items() if code in codes.split()), code)


def features(texts: list[bytes]) -> np.ndarray:
    counts = trigrams(texts, DIMS, lower=True)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))


def fit_svm(x: np.ndarray, y: np.ndarray, steps: int = 300, cost: float = 20.0) -> np.ndarray:
    """Weights and offset of the squared-hinge support vector machine for y in -1, 1; classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    size = 1 / (1 + 2 * cost * 2.0)  # rows have length sqrt(2) at most
    for k in range(steps):  # accelerated gradient descent
        gap = np.maximum(0, 1 - y * (x @ ahead))
        after = ahead - size * (ahead - 2 * cost * ((share * gap * y) @ x))
        ahead, w = after + k / (k + 3) * (after - w), after
    return w


class Model:
    def __init__(self, x: np.ndarray, codes: list[str]):
        self.codes = sorted(set(codes))
        self.families = sorted({family(c) for c in self.codes})
        own = np.array([self.codes.index(c) for c in codes])
        self.of = np.array([self.families.index(family(c)) for c in self.codes])
        self.first = []
        for f in range(len(self.families)):
            y = np.where(self.of[own] == f, 1.0, -1.0).astype(np.float32)
            self.first.append(fit_svm(x, y) if len(self.families) > 1 else np.zeros(x.shape[1] + 1, np.float32))
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        for a in range(len(self.codes)):
            for b in range(a + 1, len(self.codes)):
                if self.of[a] == self.of[b]:
                    rows = (own == a) | (own == b)
                    self.pairs[a, b] = fit_svm(x[rows], np.where(own[rows] == a, 1.0, -1.0).astype(np.float32))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        sure = lambda z: 1 / (1 + np.exp(-4 * np.clip(z, -5, 5)))
        margins = x @ np.stack(self.first, 1)
        best = margins.argmax(1)
        score = sure(margins.max(1)) if len(self.families) > 1 else np.ones(len(x))
        votes = np.where(self.of[None, :] == best[:, None], 0.0, -np.inf)
        for (a, b), w in self.pairs.items():
            z = x @ w
            votes[:, a] += (z >= 0) + 0.001 * np.tanh(z)
            votes[:, b] += (z < 0) - 0.001 * np.tanh(z)
        chosen = votes.argmax(1)
        for (a, b), w in self.pairs.items():
            z = x @ w
            score = np.where(chosen == a, score * sure(z), np.where(chosen == b, score * sure(-z), score))
        return [self.codes[i] for i in chosen], score


def train(docs: DataFrame) -> Model | None:
    prepare(docs.sparkSession)
    known = docs.where((fold(F.col("doc_id"), FOLDS) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    counts = {r["lang"]: r["n"] for r in counts.limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    if not counts:
        return None
    each = SAMPLE // len(counts)
    share = F.lit(0)
    for code, n in counts.items():
        share = F.when(F.col("lang") == code, min(1 << 30, int((1 << 30) * each / n))).otherwise(share)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share).select("lang", "text").limit(SAMPLE + 4000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(1).cast(pa.binary()).to_pylist()).astype(np.float16)
            data = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), data], ["lang", "x"])

    found = chosen.mapInArrow(run, "lang string, x binary").toArrow()
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float16).reshape(found.num_rows, -1)
    return Model(x.astype(np.float32), found.column("lang").to_pylist()) if len(x) else None


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    model = model or train(docs)
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == 1, F.lit(False))
    letters = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), letters.alias("letters"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, held_out boolean, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, known = batch.column(3).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()
            codes: list[str] = []
            scores: list[float] = []
            for start, end in slices(len(texts), 512):
                if model is None:
                    found, score = ["und"] * (end - start), np.zeros(end - start)
                else:
                    found, score = model.predict(features(texts[start:end]))
                codes += [c if k else "und" for c, k in zip(found, known[start:end])]
                scores += [float(s) if k else 1.0 for s, k in zip(score, known[start:end])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(codes), pa.array(scores)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.mapInArrow(run, schema)
