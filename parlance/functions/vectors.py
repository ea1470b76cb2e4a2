"""Vectors and logits: cosine, embedding-match F1, token probabilities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MATCH = T.StructType([T.StructField(n, T.DoubleType()) for n in ("precision", "recall", "f1")])

# Rows and columns of one product of token vectors.
TILE = 1_024


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit_rows(vectors) -> np.ndarray:
    """Stack vectors as rows of length one (a zero vector stays zero)."""
    m = np.vstack([np.asarray(v, dtype="float64") for v in vectors])
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def best_cosines(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best product of each row with the other side's rows, over tiles: no matrix of two long texts is held."""
    best_a, best_b = np.full(len(a), -np.inf), np.full(len(b), -np.inf)
    for i in range(0, len(a), TILE):
        for j in range(0, len(b), TILE):
            sims = a[i : i + TILE] @ b[j : j + TILE].T
            best_a[i : i + TILE] = np.maximum(best_a[i : i + TILE], sims.max(axis=1))
            best_b[j : j + TILE] = np.maximum(best_b[j : j + TILE], sims.max(axis=0))
    return best_a, best_b


def match_rows(predicted, reference) -> pd.DataFrame:
    """precision, recall, f1 of each pair of token vectors."""
    rows = []
    for p, r in zip(predicted, reference):
        if p is None or r is None:
            rows.append((np.nan,) * 3)
            continue
        if len(p) == 0 or len(r) == 0:
            rows.append((0.0, 0.0, 0.0))
            continue
        precision, recall = (x.mean() for x in best_cosines(unit_rows(p), unit_rows(r)))
        total = precision + recall
        rows.append((precision, recall, 2 * precision * recall / total if total else 0.0))
    return pd.DataFrame(rows, columns=["precision", "recall", "f1"], dtype="float64")


@F.pandas_udf(MATCH)
def embedding_match(predicted: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """Greedy token matching of two arrays of token vectors.

    Each predicted token takes its best cosine among the reference tokens
    (precision), and the reverse (recall). A null side (a failed call) gives
    nulls, an empty one zeros.
    """
    return match_rows(predicted, reference)


def softmax_at(logits: Column, index: Column) -> Column:
    """Probability at a 0-based position of a logits array (null outside it)."""
    values = _doubles(logits)
    top = F.array_max(values)
    total = F.aggregate(
        F.transform(values, lambda x: F.exp(x - top)), F.lit(0.0), lambda acc, x: acc + x
    )
    return F.exp(F.get(values, index) - top) / total


def last_before(tokens: Column, wanted: Column) -> Column:
    """0-based position just before the last ``wanted`` token.

    Null when the token is missing or stands first, as nothing precedes it.
    """
    from_end = F.array_position(F.reverse(tokens), wanted)
    position = F.size(tokens) - from_end - 1
    return F.when((from_end > 0) & (position >= 0), position).cast("int")


def expected_rating(logits: Column) -> Column:
    """Mean of the ratings 1..n weighted by the softmax of their logits."""
    values = _doubles(logits)
    top = F.array_max(values)
    weights = F.transform(values, lambda x: F.exp(x - top))
    weighted = F.transform(weights, lambda w, i: w * (i + 1))
    plus = lambda acc, x: acc + x
    return F.aggregate(weighted, F.lit(0.0), plus) / F.aggregate(weights, F.lit(0.0), plus)
