"""The pipeline against the same five steps in plain Python, document by document."""

import hashlib
import math

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from parlance.llm import mixing, pii, quality
from parlance.llm.queries import tokenizer_path
from tests.llm.test_pii import plain as base_spans
from tests.llm.test_simhash import classes, plain as fingerprint


def plain_features(text):
    data = (text or "").encode()
    counts = [0] * quality.DIMS
    for i in range(len(data) - 2):
        h = (data[i] * 2654435761 + data[i + 1] * 2246822519 + data[i + 2] * 3266489917) & 0xFFFFFFFF
        h ^= h >> 15
        counts[(h * 668265263 & 0xFFFFFFFF) >> 22] += 1
    total = sum(counts)
    freq = [c / max(total, 1) for c in counts]
    shape = [math.log1p(len(data)) / 10, sum(c > 0 for c in counts) / max(min(total, quality.DIMS), 1),
             math.sqrt(max(freq)), float(total == 0)]
    return np.array([math.sqrt(f) for f in freq] + shape)


def plain_redaction(text, spans):
    out, at = "", 0
    for start, end, kind in sorted(spans):
        if end > at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def plain_mix(rows):
    """doc ids in the order of the curriculum, from (doc_id, text, source)."""
    size = lambda t: len((t or "").translate({c: " " for c in range(9, 14)}).split(" ")) - (t or "").translate(
        {c: " " for c in range(9, 14)}).split(" ").count("")
    md5 = lambda v: hashlib.md5(v.encode()).hexdigest()
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sources)}
    tilt = {s: mixing.TILTS[i % 3] for i, s in enumerate(sources)}
    target, left, open_ = {}, float(sum(total.values())), list(sources)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if 3 * total[s] <= level * weight[s]]
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s], left = 3.0 * total[s], left - 3 * total[s]
            open_.remove(s)
    passes = []
    for s in sources:
        run = 0
        for i, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: (md5(str(r[0])), r[0], md5(r[1] or ""))):
            middle = run + size(t) / 2
            run += size(t)
            for e in range(max(0, math.ceil((target[s] - middle) / total[s])) if size(t) else 0):
                u, a = (middle + e * total[s]) / target[s], tilt[s]
                passes.append((u if a == 0 else (a - 1 + math.sqrt((1 - a) ** 2 + 4 * a * u)) / (2 * a), i))
    return sorted(passes)


def test_run_equals_the_plain_chain(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    text = {i: r["text"] for i, r in rows.items()}
    # 1: a score for each document from the trained weights.
    w, b = quality.train(docs, labels)
    good = [i for i in sorted(text) if 1 / (1 + math.exp(-(plain_features(text[i]) @ w + b))) >= quality.THRESHOLD]
    assert 0 < len(good) < len(text)
    # 2: all pairs of fingerprints; the first of each class stays.
    kept = [i for k, (i, c) in enumerate(zip(good, classes([fingerprint(text[i]) for i in good], 4))) if c == k]
    assert 0 < len(kept) < len(good)
    # 3: spans by the patterns and those the classifier adds, cut out one by one.
    left = docs.where(docs["doc_id"].isin(kept))
    spans = {r["doc_id"]: [s.split(":") for s in r["spans"].split(",") if s] for r in pii.find(left).collect()}
    for i in kept:
        assert {tuple(s.split(":")) for s in base_spans(text[i])} <= {tuple(s) for s in spans[i]}
        text[i] = plain_redaction(text[i] or "", [(int(s), int(e), k) for k, s, e in spans[i]])
    # 4: the order of the curriculum; 5: the library's ids.
    order = plain_mix([(i, text[i], rows[i]["source"]) for i in kept])
    library = Tokenizer.from_file(tokenizer_path())
    got = corpus_pipeline.run(spark, sf).collect()
    assert [r["position"] for r in got] == list(range(len(order)))
    assert [r["doc_id"] for r in got] == [i for _, i in order]
    for r in got:
        assert list(r["ids"]) == library.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["lang"], r["source"]) == (len(r["ids"]), rows[r["doc_id"]]["lang"], rows[r["doc_id"]]["source"])


@pytest.mark.parametrize("files", [1, 7])
def test_file_order(spark, folder, files):
    spark.range(1000).repartitionByRange(files, "id").sortWithinPartitions("id").write.parquet(folder + "/t")
    got = corpus_pipeline.in_file_order(spark.read.parquet(folder + "/t"))
    assert got.where("position = id").count() == 1000
    assert corpus_pipeline.in_file_order(spark.range(5)).columns == ["id", "position"]


def test_encoding_of_no_documents(spark, no_docs, sf, folder):
    stage = corpus_pipeline.STAGES[-1][1]
    assert stage(spark, no_docs, sf).collect() == []
    no_docs.write.parquet(folder + "/none")
    assert stage(spark, spark.read.parquet(folder + "/none"), sf).collect() == []
