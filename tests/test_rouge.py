import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parlance.functions import rouge
from parlance.functions.stem import porter

words = st.lists(st.sampled_from("abcde"), max_size=14)


def lcs_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_bit_parallel_equals_table(a, b):
    got = rouge.lcs_length(rouge.position_masks(a), len(a), b) if a else 0
    assert got == lcs_table(a, b)
    text_a, text_b = " ".join(a), " ".join(b)
    assert rouge.score(text_a, text_b) == rouge.score(text_b, text_a)
    assert 0 <= rouge.score(text_a, text_b) <= 1


CASES = [
    ("big red dog", "big red dog", 1.0), ("big red dog", "one cat", 0.0), ("a b c d", "d c b a", 0.25),
    ("a a b", "a b b", 2 / 3), ("", "x", 0.0), ("éé", "éé", 0.0), ("red bolt", "red ring", 0.5),
    ("one " * 80 + "two", "two " + "one " * 70, 2 * 70 / (81 + 71)),
]


@pytest.mark.parametrize("a,b,want", CASES)
def test_score(a, b, want):
    assert rouge.score(a, b) == pytest.approx(want)


def test_null_is_not_a_score(spark):
    assert rouge.score(None, "x") is None and rouge.score("x", None) is None
    df = spark.createDataFrame([(None, "x"), ("x", None), ("", "x"), ("x", "x")], "a string, b string")
    got = df.select(rouge.rouge_l(F.col("a"), F.col("b")).alias("p"), rouge.rouge_l(F.col("a"), F.col("b"), stem=True).alias("s"))
    assert [tuple(r) for r in got.collect()] == [(None, None), (None, None), (0.0, 0.0), (1.0, 1.0)]


def test_column_forms_agree(spark):
    rows = spark.createDataFrame([(a, b) for a, b, _ in CASES], "a string, b string")
    from parlance.functions.text import word_tokens

    got = rows.select(
        rouge.rouge_l(F.col("a"), F.col("b")).alias("u"),
        rouge.rouge_l_expr(word_tokens(F.col("a")), word_tokens(F.col("b"))).alias("e"),
    ).collect()
    for row, (_, _, want) in zip(got, CASES):
        assert row["u"] == pytest.approx(want) and row["e"] == pytest.approx(want)


@pytest.mark.parametrize("word,stem", [
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("feed", "feed"),
    ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"),
    ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
    ("relational", "relat"), ("vietnamization", "vietnam"), ("electrical", "electr"), ("hopefulness", "hope"),
    ("adoption", "adopt"), ("controlling", "control"), ("rolling", "roll"), ("probate", "probat"), ("rate", "rate"),
    ("dying", "die"), ("news", "news"), ("generously", "gener"), ("oscillators", "oscil"), ("running", "run"),
])
def test_porter(word, stem):
    assert porter(word) == stem


def test_stemmed_score():
    assert rouge.score("running dogs", "run dog", stem=True) == pytest.approx(1.0)
    assert rouge.score("running dogs", "run dog") == 0.0
