"""ROUGE-L F measure.

Two forms with equal results: a JVM expression for short lists of short texts
(topics, personas), and an Arrow UDF with a bit-parallel longest common
subsequence (Hyyro 2004) for dialogues, where the expression's cell-by-cell
cost would dominate.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.functions.stem import porter

_WORDS = re.compile("[a-z0-9]+")

# Fixed value: tokens up to this length are not stemmed.
UNSTEMMED_LENGTH = 3


def tokenize(text: str | None, stem: bool = False) -> list[str]:
    words = _WORDS.findall(text.lower()) if text else []
    if stem:
        return [porter(w) if len(w) > UNSTEMMED_LENGTH else w for w in words]
    return words


def position_masks(tokens: Sequence[str]) -> dict[str, int]:
    """Token -> integer with one bit per position where it stands."""
    masks: dict[str, int] = {}
    for i, token in enumerate(tokens):
        masks[token] = masks.get(token, 0) | 1 << i
    return masks


def lcs_length(masks: dict[str, int], n: int, other: Sequence[str], need: float = 0.0) -> int:
    """Longest common subsequence of a masked list of ``n`` tokens and ``other``.

    Stops early, with 0, once fewer than ``need`` can be reached.
    """
    full = (1 << n) - 1
    row, m = full, len(other)
    find = masks.get
    for lo in range(0, m, 64):
        for token in other[lo : lo + 64]:
            hit = find(token)
            if hit:
                common = row & hit
                row = (row + common) | (row - common)
        # Carries above bit n do no harm and are cut once per stretch.
        row &= full
        if n - row.bit_count() + max(m - lo - 64, 0) < need:
            return 0
    return n - row.bit_count()


def f_measure(lcs: int, n: int, m: int) -> float:
    return 2.0 * lcs / (n + m) if lcs else 0.0


def score(reference: str | None, prediction: str | None, stem: bool = False) -> float | None:
    """F measure of two texts; null (a failed call) gives null, a text without tokens 0."""
    if reference is None or prediction is None:
        return None
    a, b = sorted((tokenize(reference, stem), tokenize(prediction, stem)), key=len, reverse=True)
    if not b:
        return 0.0
    return f_measure(lcs_length(position_masks(a), len(a), b), len(a), len(b))


class Prepared:
    """A token list with what repeated comparisons need of it."""

    __slots__ = ("tokens", "counts", "masks")

    def __init__(self, tokens: Sequence[str]):
        self.tokens, self.counts, self.masks = tokens, Counter(tokens), None

    def reaches(self, other: Prepared, threshold: float) -> bool:
        """Whether the F measure of both is at least ``threshold``.

        The common subsequence cannot be longer than the shorter list, nor
        than the overlap of the two multisets; only then is it computed.
        """
        n, m = len(self.tokens), len(other.tokens)
        need = threshold * (n + m) / 2 - 1e-9
        if min(n, m) < need:
            return False
        small, large = sorted((self.counts, other.counts), key=len)
        if sum(min(c, large[t]) for t, c in small.items() if t in large) < need:
            return False
        # The loop goes over the shorter list, the bits over the longer one.
        long, short = (self, other) if n >= m else (other, self)
        if long.masks is None:
            long.masks = position_masks(long.tokens)
        size = len(long.tokens)
        return f_measure(lcs_length(long.masks, size, short.tokens, need), n, m) >= threshold


@F.pandas_udf(T.DoubleType())
def _plain(reference: pd.Series, prediction: pd.Series) -> pd.Series:
    return pd.Series([score(r, p) for r, p in zip(reference, prediction)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _stemmed(reference: pd.Series, prediction: pd.Series) -> pd.Series:
    return pd.Series([score(r, p, True) for r, p in zip(reference, prediction)], dtype="float64")


def rouge_l(reference: Column, prediction: Column, stem: bool = False) -> Column:
    """F measure of two text columns; 0 when either side has no token, null when either is null."""
    return (_stemmed if stem else _plain)(reference, prediction)


def lcs_expr(a: Column, b: Column) -> Column:
    """Longest common subsequence of two short token arrays, in the JVM.

    Folds over ``a`` carrying one row of the table; each cell is appended from
    the cell above, the cell to the left and the diagonal.
    """
    zero = F.transform(F.concat(F.array(F.lit(0)), F.transform(b, lambda _: F.lit(0))), lambda x: x)

    def next_row(row: Column, token: Column) -> Column:
        def cell(acc: Column, other: Column) -> Column:
            j = F.size(acc)
            return F.concat(
                acc,
                F.array(
                    F.when(other == token, F.get(row, j - 1) + 1).otherwise(
                        F.greatest(F.get(row, j), F.element_at(acc, -1))
                    )
                ),
            )

        return F.aggregate(b, F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(a, zero, next_row), -1)


def rouge_l_expr(a: Column, b: Column) -> Column:
    """F measure of two short token arrays, in the JVM."""
    return F.when(F.arrays_overlap(a, b), 2.0 * lcs_expr(a, b) / (F.size(a) + F.size(b))).otherwise(0.0)
