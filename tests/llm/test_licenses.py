import re

import pytest

from parlance.llm import licenses


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({k for _, k in found}))


def check(rows, texts):
    for r in rows:
        assert tuple(r)[1:6] == plain(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and list(r["labels"].split(",")) == sorted(set(r["labels"].split(",")))


def test_base_phrases(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(licenses.scan(docs).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})


def test_matching_statistics():
    """The longest run that ends at each place, against a search in the templates."""
    templates = [("x", "a b c a b d"), ("y", "b c a e"), ("z", "a b c")]
    automaton = licenses.Automaton(templates)
    lists = [t.split() for _, t in templates]
    words = "a b c a e b c a b c a b d a b c".split()
    automaton.least = 1

    def longest(end):
        return max((n for n in range(end + 1) for t in lists for i in range(len(t)) if n and t[i : i + n] == words[end - n : end]), default=0)

    state = length = 0
    stats = []
    for w in [x.encode() for x in words]:
        while state and w not in automaton.step[state]:
            state = automaton.link[state]
            length = automaton.length[state]
        if w in automaton.step[state]:
            state, length = automaton.step[state][w], length + 1
        stats.append(length)
    assert stats == [longest(i + 1) for i in range(len(words))]
    ends = [(e, n) for e, n, _ in automaton.long_matches([w.encode() for w in words], 0)]
    full = [longest(i + 1) for i in range(len(words))] + [0]
    assert ends == [(i + 1, full[i]) for i in range(len(words)) if full[i] and full[i + 1] <= full[i]]


@pytest.mark.parametrize("text, label", [
    ("so: Released under the MIT License. Yes", "mit"), ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
    ("Permission is hereby granted, free of charge, to any person obtaining one copy of this software and associated "
     "documentation files (the Software), to deal in the Software without any restriction", "mit"),
])
def test_labels(spark, text, label):
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).head()
    assert label in row["labels"].split(",") and row["score"] > 0.7


def test_plain_prose_has_no_label(spark):
    text = "the terms of the work are under discussion and the version of the source is free to use"
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).head()
    assert row["labels"] == "" and row["score"] < 0.5


def test_odd_rows(odd_docs, no_docs):
    rows = licenses.scan(odd_docs).collect()
    assert len(rows) == 12
    check([r for r in rows if r["doc_id"]], {r["doc_id"]: r["text"] for r in odd_docs.collect()})
    assert licenses.scan(no_docs).count() == 0
