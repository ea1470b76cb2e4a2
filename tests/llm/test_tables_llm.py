"""URL rules, mixing, quality, language and the pipeline."""

import math
import re
import zlib

import numpy as np
import pytest

from parlance.llm import language, mixing, quality, urls
from parlance.llm.queries import RULES

PAGES = "page_id long, url string, host string, key string"


def verdict_of(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h + p), h + p, v) for v, h, p in RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, None, urls.DEFAULT))
    return host, path, best[1], best[2]


def test_urls_equal_the_rules_in_plain_python(spark):
    seen = [
        "https://example.org/es/1", "https://EXAMPLE.org/en/12", "http://a.example.org/en/2", "https://badexample.org/es/",
        "https://x.com/fr/a?b#c", "https://com/de/", "https://shop.com/de", "https://example.org", "ftp://example.org?/es/",
        "http://u.org/a://b", "no scheme", "", None, "://", "https://é.org/ü", "https://x.net/" + "a/" * 5_000,
    ] + [f"https://site{i}.com/{'de' if i % 3 else 'fr'}/{i % 50}" for i in range(400)]
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(seen)] + [(None, seen[0], "h", "k")], PAGES)
    got = urls.judge(pages, RULES).collect()
    assert len(got) == len(seen) + 1
    for r in got:
        url = seen[r["page_id"]] if r["page_id"] is not None else seen[0]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == verdict_of(url), url


def test_urls_of_none_and_over_the_bound(spark):
    none = spark.createDataFrame([], PAGES)
    assert urls.judge(none, RULES).count() == 0
    some = spark.createDataFrame([(1, "https://example.org/es/", "h", "k")], PAGES)
    with pytest.raises(ValueError):
        urls.judge(some, RULES, most_bits=32)


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(60_000).selectExpr("cast(id as string) as key")
    cascade = urls.Cascade(keys.where("key % 7 = 0"), keys)
    assert len(cascade.levels) >= 2
    wrong = keys.where(cascade.has(keys["key"]) != (keys["key"] % 7 == 0))
    assert wrong.isEmpty()


def test_mixing_meets_its_targets(spark, odd_docs, no_docs):
    rows = mixing.mixture(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    total = sum(r["size"] for r in rows)
    by_source = {}
    for r in rows:
        by_source.setdefault((r["source_size"], r["target"]), []).append(r)
        assert r["taken"] <= mixing.CAP * r["size"]
        assert r["taken"] == 0 or r["taken"] % r["size"] == 0
    for (size, target), group in by_source.items():
        assert target <= mixing.CAP * size + 1e-6
        assert abs(sum(r["taken"] for r in group) - target) <= max(r["size"] for r in group)
    assert math.isclose(sum(t for _, t in by_source), total, rel_tol=1e-9) or all(
        math.isclose(t, mixing.CAP * s) for s, t in by_source
    )
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"], str(r["position"]))
    assert sorted(map(key, rows)) == sorted(map(key, mixing.mixture(odd_docs).collect()))
    assert mixing.mixture(no_docs).count() == 0 and mixing.curriculum(no_docs).count() == 0


def test_curriculum_repeats_rows_as_taken(spark, odd_docs):
    passes = mixing.curriculum(odd_docs)
    assert passes.columns == odd_docs.columns
    want = sum(r["taken"] // r["size"] for r in mixing.mixture(odd_docs).collect() if r["size"])
    assert passes.count() == want


def test_positions_invert_the_cumulative_demand(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), "sabc"[i % 4]) for i in range(400)], "doc_id long, text string, source string")
    rows = mixing.mix(docs.select(*mixing._keys(docs))).collect()
    for r in rows:
        for e, t in enumerate(r["positions"]):
            middle = r["base"] + r["within"] + r["size"] / 2 + e * r["source_size"]
            assert math.isclose(t + r["tilt"] * (t * t - t), middle / r["target"], abs_tol=1e-9)
            assert 0 <= t <= 1


def area(rows, labels):
    """Share of (1, 0) pairs of held-out labelled rows that the score orders rightly."""
    good = np.array([r["score"] for r in rows if r["held_out"] and labels.get(r["doc_id"]) == 1])
    bad = np.array([r["score"] for r in rows if r["held_out"] and labels.get(r["doc_id"]) == 0])
    assert len(good) > 20 and len(bad) > 5
    return ((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2)


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    rows = quality.classify(docs.select("doc_id", "text"), labels).select("_row.doc_id", "held_out", "score", "predicted").collect()
    assert area(rows, known) >= 0.75
    held = [r for r in rows if r["held_out"] and r["doc_id"] in known]
    assert sum(r["predicted"] == known[r["doc_id"]] for r in held) >= 0.8 * len(held)


def test_quality_learns_and_keeps_rows(spark, odd_docs, no_docs, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.classify(docs.select("doc_id", "text"), labels).select("_row.doc_id", "held_out", "score", "predicted").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    odd = quality.classify(odd_docs, labels)
    assert odd.count() == odd_docs.count()
    assert quality.keep_good(odd_docs, labels).columns == odd_docs.columns
    assert quality.classify(no_docs, labels).count() == 0
    unlabelled = quality.classify(odd_docs, labels.where("false")).select("score").distinct().collect()
    assert [r["score"] for r in unlabelled] == [0.5]


def test_language_on_held_out_rows(spark, odd_docs, no_docs, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = [r for r in language.identify(docs).collect() if r["held_out"] and truth[r["doc_id"]]]
    assert rows
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) / len(rows) >= 0.8
    odd = {r["doc_id"]: r for r in language.identify(odd_docs).collect()}
    assert odd[3]["lang_pred"] == odd[4]["lang_pred"] == odd[5]["lang_pred"] == "und"
    assert language.identify(odd_docs).count() == odd_docs.count()
    assert language.identify(no_docs).count() == 0


def test_pipeline_stages_on_odd_rows(spark, odd_docs, no_docs, sf):
    import corpus_pipeline

    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, sf)
            assert after.columns == docs.columns
            after.count()
    coded = corpus_pipeline.STAGES[-1][1](spark, odd_docs, sf).collect()
    assert len(coded) == odd_docs.count()
    assert all(r["n_tokens"] == len(r["ids"]) for r in coded)
