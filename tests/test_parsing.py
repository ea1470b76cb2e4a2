import pytest
from pyspark.sql import functions as F

from parlance.functions import parsing


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).head()["x"]


@pytest.mark.parametrize("text,items", [
    ('["a", "b c"]', ["a", "b c"]),
    ("Sure: ['it\\'s', \"b\"] ok", ["it's", "b"]),
    ('["a", "b",]', ["a", "b"]),
    ('["a" "b"]', ["ab"]),
    ("[]", []),
    ('[\n "a",\n "b"\n]', ["a", "b"]),
    ('["tab\\t"]', ["tab\t"]),
    ('["é", "ß"]', ["é", "ß"]),
])
def test_lists(spark, text, items):
    got = one(spark, text, parsing.parse_list)
    assert (got["items"], got["error"]) == (items, None)


@pytest.mark.parametrize("text", [
    '["a]b", "c"]', '["a", "b"', "", None, "no list", '] ["a"', '["a", 1]', "[null]", '["a", None]', "[x for x in y]",
])
def test_bad_lists(spark, text):
    got = one(spark, text, parsing.parse_list)
    assert got["items"] is None and got["error"]


@pytest.mark.parametrize("text,cot,dialogue,path", [
    ("x<cot>why</cot>\n<dialogue>#A#: hi</dialogue>", "why", "#A#: hi", "markup"),
    ("<dialogue>d</dialogue><cot>c</cot>", "c", "d", "markup"),
    ("<COT>c</COT><Dialogue>d</Dialogue>", "c", "d", "markup"),
    ("<cot>a &amp; b</cot><dialogue>x &lt; y</dialogue>", "a & b", "x < y", "markup"),
    ("<cot>a <b>bold</b></cot><dialogue>d</dialogue>", "a bold", "d", "markup"),
    ("<cot>c</cot><dialogue>open", "c", "open", "markup"),
    ("<dialogue>&amp;d</dialogue>", "<dialogue>&amp;d</dialogue>", "&amp;d", "search"),
    ("plain &amp; text", "plain &amp; text", "plain &amp; text", "search"),
    ("<cot></cot><dialogue>d</dialogue>", "", "d", "search"),
    ("</dialogue>x<dialogue>", "</dialogue>x<dialogue>", "", "search"),
    ("<cot>a<dialogue>d</cot>e</dialogue>", "ad", "d", "markup"),
    ("<cot>c</cot><dialogue>one</dialogue><dialogue>two</dialogue>", "c", "one", "markup"),
    ("<cot>1<br>2</cot><dialogue>d<!-- note --></dialogue>", "12", "d", "markup"),
])
def test_sections(spark, text, cot, dialogue, path):
    got = one(spark, text, parsing.extract_sections)
    assert (got["cot"], got["dialogue"], got["extraction_path"]) == (cot, dialogue, path)


@pytest.mark.parametrize("text,score", [
    ("Score: 8", 8), ("Score:8", 8), ("Score: 10", 10), ("Score: 100", None), ("Score:\n7 of 10", 7),
    ("Score: 3 Score: 9", 3), ("none", None), ("score: 5", None), ("Score: 0", None), (None, None),
    ("Score: 99999999999999", None),
])
def test_judge_score(spark, text, score):
    assert one(spark, text, parsing.judge_score) == score
