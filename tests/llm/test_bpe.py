import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parlance.llm import bpe
from parlance.llm.queries import TOKENIZER, op9_bpe, tokenizer_path

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(str(public_tokenizers.path(TOKENIZER)))


def encoded(text):
    words = bpe.Splitter(PATH)(text)
    return [i for ids in bpe.WordEncoder(PATH)(words) for i in ids] if words else []


SPLIT, ENCODE, LIBRARY = bpe.Splitter(PATH), bpe.WordEncoder(PATH), Tokenizer.from_file(PATH)


def test_single_characters(library):
    """Every character of the plain path, between letters and alone."""
    for c in range(0x260):
        text = f"a{chr(c)}b {chr(c)}"
        words = SPLIT(text)
        assert [i for ids in ENCODE(words) for i in ids] == library.encode(text, add_special_tokens=False).ids, c


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aS'tréİΣ́ <|endoftx>\t\n1½…", max_size=60))
def test_words_encode_as_the_library(text):
    words = SPLIT(text)
    assert [i for ids in ENCODE(words) for i in ids] == LIBRARY.encode(text, add_special_tokens=False).ids


def test_special_tokens(library):
    text = "a<|endoftext|> b<|startoftext|><|endoftext|>c"
    assert encoded(text) == library.encode(text, add_special_tokens=False).ids


def check(docs, out, library):
    want = {}
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        row = (r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
        want[row] = want.get(row, 0) + 1
    got = {}
    for r in out.collect():
        got[tuple(r)] = got.get(tuple(r), 0) + 1
    assert got == want


def test_query_against_the_library(spark, sf, library):
    check(spark.read.parquet(f"{sf}/documents.parquet"), op9_bpe(spark, sf), library)


def test_odd_rows(odd_docs, no_docs, library):
    check(odd_docs, bpe.digests(odd_docs, PATH), library)
    assert bpe.digests(no_docs, PATH).count() == 0


def test_decode_joins_pieces(spark, library):
    """Any ids, whatever else the rows hold; numbers that are no id are left out."""
    size = library.get_vocab_size()
    lists = [[5, 6, 5], [], None, [size + 7, 300, -3, None, 301], list(range(0, size, 7)), [300] * 100_000]
    rows = [(i, x, "old", f"w{i}") for i, x in enumerate(lists)] * 2
    docs = spark.createDataFrame(rows, "row int, ids array<int>, decoded string, `block` string")
    names = {i: library.id_to_token(i) for i in range(size)}
    want = [(i, x, w, None if x is None else " ".join(names[k] for k in x if k in names)) for i, x, _, w in rows]
    for batch in ("10000", "2"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        out = bpe.decode(docs, PATH)
        assert out.columns == ["row", "ids", "block", "decoded"]
        assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(want, key=str)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert bpe.decode(docs.limit(0), PATH).count() == 0


def test_decode_joins_a_distinct_id_once_a_block(spark, library):
    """Before, every row sent its own distinct ids through the join."""
    text = "the cat sat on the mat, don't 12 <|endoftext|> unbelievably"
    docs = spark.createDataFrame([(i, None if i % 50 == 7 else text) for i in range(400)], "doc_id long, text string")
    ids = library.encode(text, add_special_tokens=False).ids
    spread = bpe.encode(docs, PATH, announce=True)
    assert spread.columns == ["_row", "ids", "need"]
    rows = spread.collect()
    assert [r["need"] for r in rows if r["need"] is not None] == sorted(set(ids))
    assert all(r["_row"] is None and r["ids"] is None for r in rows[: len(set(ids))])
    kept = {r["_row"]["doc_id"]: r["ids"] for r in rows if r["need"] is None}
    assert kept == {i: [] if i % 50 == 7 else ids for i in range(400)}
    check(docs, bpe.digests(docs, PATH), library)
    check(docs, bpe.decode(bpe.encode(docs, PATH), PATH).select(
        "_row.doc_id", F.size("ids"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256), F.sha2("decoded", 256),
    ), library)
    for out in (bpe.decode(spread, PATH, need="need"), bpe.decode(bpe.encode(docs, PATH), PATH)):
        assert out.columns == ["_row", "ids", "decoded"] and out.count() == 400
        assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


def test_texts_are_taken_apart_in_chunks(monkeypatch):
    texts = ["b a b", "", "c", "", "a " * 30 + "é", "d"]
    packed = pa.array([zstandard.ZstdCompressor().compress(" ".join(t.split()).encode()) for t in texts], pa.binary())
    for chunk in (1, 5, 1 << 20):
        monkeypatch.setattr(bpe, "CHUNK_BYTES", chunk)
        found = list(bpe._unpacked(packed))
        assert len(found) == {1: 4, 5: 3, 1 << 20: 1}[chunk]
        assert [x or [] for lists in found for x in lists.to_pylist()] == [t.split() for t in texts]


def test_blocks_of_several_chunks(spark, library):
    """Two blocks of over CHUNK_BYTES: words of one chunk and of several, texts without words between them."""
    words = [f"{a}{b}{c}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzéßñø"]
    texts = [" ".join(words[i % 900 : i % 900 + 100] * 400) for i in range(0, 900, 13)]
    rows = [(i, t if i % 5 else None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    assert sum(len(t.encode()) for i, t in rows if t) > 2 * bpe.CHUNK_BYTES
    check(docs, bpe.digests(docs, PATH), library)


def test_many_blocks(odd_docs, library):
    rows = bpe.encode(odd_docs, PATH, block_chars=50_000).collect()
    assert len(rows) == 12
    ids = {r["_row"]["doc_id"]: list(r["ids"]) for r in rows}
    text = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for k in (1, 6, 8, 9):
        assert ids[k] == library.encode(text[k], add_special_tokens=False).ids


def test_long_texts_in_pieces(monkeypatch, library):
    split, text = bpe.Splitter(PATH), "Don't stop\tat 12 ége\nΣΑΣ x<|endoftext|>y  " * 40
    for odd in (text, text.encode("ascii", "ignore").decode(), "a" * 300, " \n ", ""):
        whole = split(odd)
        monkeypatch.setattr(bpe, "PIECE_CHARS", 7)
        assert split(odd) == whole
        monkeypatch.undo()
        ids = [i for w in bpe.WordEncoder(PATH)(whole) for i in w]
        assert ids == library.encode(odd, add_special_tokens=False).ids
