import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parlance.functions import text


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)],
                                 "i int, a string, b string" if isinstance(values[0], tuple) else "i int, a string")
    return [r["x"] for r in rows.select("i", expr.alias("x")).orderBy("i").collect()]


def test_word_tokens(spark):
    got = column(spark, ["Hello, World-9", None, "", "éé", "café au lait"], text.word_tokens(F.col("a")))
    assert got == [["hello", "world", "9"], [], [], [], ["caf", "au", "lait"]]


ANSWERS = ["The  cat, a dog!", "an-the", "A", None, "", "theater\tan ant", "a–the x", "“The” end", "THE_THE"]


def normal(s):
    s = "".join(c for c in s.lower() if c not in set(string.punctuation))
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", s).split())


def test_normalize_answer(spark):
    given = [a for a in ANSWERS if a is not None]
    assert column(spark, given, text.normalize_answer(F.col("a"))) == [normal(a) for a in given]


@pytest.mark.parametrize("gold,pred,want", [
    ("", "", 1.0), ("the", "a an", 1.0), ("cat", "", 0.0), (None, None, 1.0), ("x", "y", 0.0),
    ("cat cat dog", "cat dog dog", 2 / 3), ("big red dog", "red dog", 0.8),
])
def test_token_f1(spark, gold, pred, want):
    assert column(spark, [(gold, pred)], text.token_f1(F.col("a"), F.col("b"))) == [pytest.approx(want)]


def test_speakers(spark):
    got = column(spark, ["#A#: hi\n#B#: yo\n#A#: so", "no label", "#A# no colon"], text.speakers(F.col("a")))
    assert got == [["#A#", "#B#", "#A#"], [], []]


@pytest.mark.parametrize("dialogue,tail", [
    ("#A#: hi\n#B#: yo", "\n    #A#: ok"),
    ("#A#: hi\n#B#: yo\n#A#: so", "\n    #B#: ok"),
    ("#A#: hi\n#B#: yo\n#C#: so", "\n    #B#: ok"),
    ("#A#: hi", "\n ok"), ("plain", "\n ok"), ("", "\n ok"),
])
def test_append_followup(spark, dialogue, tail):
    assert column(spark, [dialogue], text.append_followup(F.col("a"), F.lit("ok"))) == [dialogue + tail]


def test_context_response(spark):
    got = column(spark, ["one", "a\nb", "a\nb\n", "", "a\n\nc"], text.context_response(F.col("a")))
    assert [g and tuple(g) for g in got] == [None, ("a", "b"), ("a\nb", ""), None, ("a\n", "c")]


def test_counter_overlap_matches_token_f1(spark):
    a, b = "one two two three " * 50, "two two two four three " * 40
    same = sum((Counter(a.split()) & Counter(b.split())).values())
    p, r = same / len(b.split()), same / len(a.split())
    assert column(spark, [(a, b)], text.token_f1(F.col("a"), F.col("b"))) == [pytest.approx(2 * p * r / (p + r))]
