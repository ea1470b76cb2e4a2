import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from parlance.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def check(rows, texts):
    for r in rows:
        want = plain(texts[r["doc_id"]])
        count = {k: sum(w.startswith(k + ":") for w in want) for k in PATTERNS}
        assert [r[f"n_{k}"] for k in PATTERNS] == list(count.values()), (r["doc_id"], want)
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r["spans"].split(","))  | set(), r["spans"]


def test_against_plain_patterns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(pii.find(docs).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})


CASES = [
    "a@b.c", "a@b", "a@b.", "x@y.com_foo@z.org", "x@y.com@z.org", "@y.com", "..a@b.c.d-e..f", "a@@b.c a@b..c",
    "é@b.c \U0001f600 jo@mail.example.com!", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.1 1.2.3", "00001.2.3.4", "1..2.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111", "41111111111111114111111111111111", "4111 1111 1111 1111-",
    "+1 (974) 555-3436", "+1", "++1 2345678", "+1 2345678+1 2345678", "+123456789012345678", "+1 .....2345678)", "x" * 5000,
    "1" * 5000, "1 " * 5000, "a." * 5000 + "@", "a@" + "b." * 5000, "+1" + "(" * 5000, "", None,
]


def test_cases(spark):
    docs = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    rows = pii.find(docs).collect()
    assert len(rows) == len(CASES)
    for r in rows:
        want = plain(CASES[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), CASES[r["doc_id"]]
        assert set(want) <= set(r["spans"].split(",")) or not want


def test_method_learns_secrets(spark):
    """Assigned tokens are added; plain numbers and words are left alone."""
    token = 'here token = "cf1d64a9a4cd9723e1f4eafc27395915e6868ffa" and more'
    rows = [(i, token.replace("cf", f"{i:02x}")) for i in range(60)]
    rows += [(100 + i, f"call jo{i}@mail.example.com or +1 (974) 555-34{i:02d} now") for i in range(60)]
    rows += [(200 + i, f"order 1111-1111-1111-11{i:02d} of the page") for i in range(60)]
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == "secret:14:54" for i in range(60))
    assert not any(got[200 + i] for i in range(60) if not plain(rows[120 + i][1]))


def many(n):
    """A text with ``n`` of each of several kinds, some of them overlapping, some side by side without a gap."""
    parts = []
    for i in range(n):
        parts += [f"mail jo{i}@mail.example.com", f"10.0.{i % 300}.7", f"+1 (974) 555-{i % 10000:04d}", f"key={i * 7919:032x}",
                  f"token: {i:024d}@a.b", "x@y.com_é@z.org+12345678+87654321", "4111 1111 1111 1111", "😀"]
    return " ".join(parts)


def test_texts_with_thousands_of_matches(spark):
    """Blocks change nothing: places equal the plain patterns', added spans and cuts a plain walk over all candidates."""
    texts = {1: many(700), 2: many(3), 3: many(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = docs.select("doc_id", "text", pii.candidates(F.col("text")).alias("found"))
    learnt = pii.learn(found.select(F.explode("found").alias("c")).select("c.s"))
    rows = pii.find(docs).collect()
    check(rows, texts)
    spans = {r["doc_id"]: r["spans"] for r in rows}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    for r in found.collect():
        base = [c["s"] for c in r["found"] if c["base"]]
        taken = [(s["kind"], s["start"], s["end"]) for s in base]
        want = list(taken)
        for c in r["found"]:
            s = c["s"]
            odds = learnt.prior + sum(table.get(s[name], 0.0) for name, table in learnt.odds.items())
            sure = not c["base"] and s["valid"] and odds >= math.log(pii.ACCEPT / (1 - pii.ACCEPT))
            if sure and all(end <= s["start"] or s["end"] <= start for _, start, end in taken):
                want.append((s["kind"], s["start"], s["end"]))
        assert spans[r["doc_id"]] == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(want))
        out, at = "", 0
        for a, b, k in sorted((a, b, k) for k, a, b in want):
            if b > at:
                out, at = out + r["text"][at:max(at, a)] + f"[{pii.KINDS[k].upper()}]", b
        assert clean[r["doc_id"]] == out + r["text"][at:]


def test_odd_rows(odd_docs, no_docs):
    rows = pii.find(odd_docs).collect()
    assert len(rows) == 12
    nine = next(r for r in rows if r["doc_id"] == 9)
    assert [nine[f"n_{k}"] for k in PATTERNS] == [1, 1, 1, 1]
    assert pii.find(no_docs).count() == 0


def test_redact(odd_docs, no_docs):
    out = pii.redact(odd_docs)
    assert out.columns == odd_docs.columns and out.schema == odd_docs.schema
    rows = out.collect()
    nine = next(r for r in rows if r["doc_id"] == 9)
    assert nine["text"] == "[PHONE], [EMAIL]; [CARD] and [IP]" and nine["n_chars"] == len(nine["text"])
    before = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    assert all(r["text"] == before[r["doc_id"]] for r in rows if r["doc_id"] not in (9, None))
    assert pii.redact(no_docs).count() == 0


def test_no_python_in_the_plan(odd_docs):
    plan = pii.find(odd_docs)._jdf.queryExecution().toString() + pii.redact(odd_docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
