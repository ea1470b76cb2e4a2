"""Dialogue text as Column expressions: tokens, answers, speakers, turns.

Everything here stays inside the JVM; nothing needs a shuffle.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ASCII punctuation and the English articles that answer
# normalization removes.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")

# Fixed value: a speaker label is a run between two '#', followed by a colon.
SPEAKER_PATTERN = "(#.*?#):"


def word_text(text: Column) -> Column:
    """Lower-cased text with every run of other than [a-z0-9] as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def word_tokens(text: Column) -> Column:
    """Token array for ROUGE; empty for null or letterless text."""
    return F.filter(F.split(F.coalesce(word_text(text), F.lit("")), " "), lambda t: t != "")


def strip_blanks(text: Column) -> Column:
    """Trim every Unicode blank, not only the space character."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_answer(text: Column) -> Column:
    """Lower, drop punctuation, drop articles, squeeze blanks, in this order."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    articles = "|".join(ARTICLES)
    no_articles = F.regexp_replace(bare, rf"(?U)\b({articles})\b", " ")
    return strip_blanks(F.regexp_replace(no_articles, r"(?U)\s+", " "))


def answer_tokens(text: Column) -> Column:
    """Normalized tokens; empty for null or empty text."""
    normal = F.coalesce(normalize_answer(text), F.lit(""))
    return F.filter(F.split(normal, " "), lambda t: t != "")


@F.pandas_udf(T.IntegerType())
def _bag_overlap(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(
        [sum((Counter(a) & Counter(b)).values()) for a, b in zip(left, right)], dtype="int32"
    )


def token_f1(gold: Column, predicted: Column) -> Column:
    """F1 over the two token multisets.

    Two empty sides agree (1), one empty side does not (0). The overlap is
    linear in the text, which a nested array expression would not be.
    """
    a, b = answer_tokens(gold), answer_tokens(predicted)
    n_a, n_b = F.size(a), F.size(b)
    same = _bag_overlap(a, b)
    return (
        F.when((n_a == 0) | (n_b == 0), F.when((n_a == 0) & (n_b == 0), 1.0).otherwise(0.0))
        .when(same == 0, 0.0)
        .otherwise(2.0 * same / (n_a + n_b))
    )


def speakers(dialogue: Column) -> Column:
    """Speaker labels of all turns, in order."""
    return F.regexp_extract_all(dialogue, F.lit(SPEAKER_PATTERN), F.lit(1))


def distinct_speakers(dialogue: Column) -> Column:
    return F.array_distinct(speakers(dialogue))


def followup_lead(dialogue: Column) -> Column:
    """What stands between a dialogue and one more utterance.

    With two or more speakers the second one answers, unless it spoke last;
    then the first one does. Otherwise the utterance has no speaker.
    """
    turns = speakers(dialogue)
    names = F.array_distinct(turns)
    last = F.element_at(turns, -1)
    second = F.get(names, F.lit(1))
    speaker = F.when(last == second, F.get(names, F.lit(0))).otherwise(second)
    return F.when(F.size(names) >= 2, F.concat(F.lit("\n    "), speaker, F.lit(": "))).otherwise("\n ")


def append_followup(dialogue: Column, followup: Column) -> Column:
    return F.concat(dialogue, followup_lead(dialogue), followup)


def context_response(dialogue: Column) -> Column:
    """struct(context, response): the last line answers the lines before it.

    Null when the dialogue has fewer than two lines.
    """
    lines = F.split(dialogue, "\n", -1)
    return F.when(
        F.size(lines) >= 2,
        F.struct(
            F.array_join(F.slice(lines, F.lit(1), F.size(lines) - 1), "\n").alias("context"),
            F.element_at(lines, -1).alias("response"),
        ),
    )


def render_turns(turns: Column) -> Column:
    """One dialogue text from an ordered array of struct(role, text)."""
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit("#"), t["role"], F.lit("#: "), t["text"])), "\n"
    )
