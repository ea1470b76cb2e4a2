"""BPE encoding and decoding through a table of distinct words.

A tokenizer file (its path is a parameter) says how a text is normalised and
split. Texts are split into words in Spark and dealt out in blocks of about
``BLOCK_CHARS`` characters. The distinct words of each block are shuffled by
word; there each distinct word of the corpus is encoded once, and its ids go
back to every block that has it. A block then replaces its words by their ids,
position by position. Only the texts (once, already split) and the distinct
words of each block are shuffled: a frequent word is one row a block, and no
word table is sent to every worker.

Decoding is a join with the id-to-piece table, which is as large as the
vocabulary (``MOST_PIECES`` rows at most) and so is broadcast. Each distinct id
goes ahead, as a row of its own, of the rows that use it: once a block where
``encode`` announces it, else once a partition. A broadcast join leaves the
order of the other side, so the pieces come before the rows and are put in the
places of their ids without a shuffle. They are joined as the library's
decode() does for a tokenizer without a decoder.

Defined results: a null or empty text has no ids and decodes to the empty
text. Rows with null or repeated ids are encoded like any other. To decode,
null ids have a null text, and numbers that are no id of the vocabulary (nulls
among them) are left out.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import prepare

BLOCK_CHARS = 10_000_000
# So many rows (word and block) of a task are packed together on their way back.
PACK_ROWS = 250_000
MOST_PIECES = 1_000_000
# Texts are taken apart into words about so many bytes at a time.
CHUNK_BYTES = 1 << 20
# A long text is split in pieces of about so many characters, cut before white space, where no word can be cut.
PIECE_CHARS = 1 << 16
# Characters below this one are split by a plain pattern; a text with others goes through the library's own steps.
_SIMPLE = 0x100
_BLANK = re.compile(r"[ \t\n\r]")


def _simple(text: str) -> bool:
    """Whether all characters are below _SIMPLE."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + PIECE_CHARS)
        to = blank.start() if blank else len(text)
        yield text[at:to]
        at = to


class Splitter:
    """Words of a text as the tokenizer's normalizer and pre-tokenizer make them.

    A special token found in the text is the word ``tab + id``; no other word
    holds white space.
    """

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.normalize = Tokenizer.from_file(path).normalizer.normalize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        steps = spec["pre_tokenizer"]["pretokenizers"]
        pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
        self.slow = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str
        self.marks = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        # The same pattern for characters below _SIMPLE, with the classes written out.
        kind = {c: unicodedata.category(chr(c))[0] for c in range(_SIMPLE)}
        spell = lambda test: "".join(re.escape(chr(c)) for c in range(_SIMPLE) if test(c))
        blank = {9, 10, 11, 12, 13, 32, 0x85, 0xA0}
        letters, digits = spell(lambda c: kind[c] == "L"), spell(lambda c: kind[c] == "N")
        others = spell(lambda c: kind[c] not in "LN" and c not in blank)
        plain = pattern.replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{digits}]")
        plain = plain.replace(r"[^\s\p{L}\p{N}]", f"[{others}]")
        # Letters first: no other alternative begins with one, so the matches are the same.
        run = f"[{letters}]+"
        front, _, back = plain.partition(run)
        if back and not any(a[:1] in letters for a in front.split("|") if a):
            plain = f"{run}|{front}{back.lstrip('|')}"
        self.plain = None if r"\p" in plain else re.compile(plain).findall

    def _words(self, text: str) -> str:
        return " ".join(filter(None, map(self._piece, _pieces(text))))

    def _piece(self, text: str) -> str:
        if self.plain is not None and _simple(text):
            return " ".join(self.plain(text.lower()))
        return " ".join([word for word, _ in self.slow(self.normalize(text))])

    def joined(self, text: str) -> str:
        """The words, joined by single spaces."""
        if "<" not in text or not self.marks.search(text):
            return self._words(text)
        parts, at = [], 0
        for m in self.marks.finditer(text):
            parts += [self._words(text[at : m.start()]), f"\t{self.special[m.group()]}"]
            at = m.end()
        return " ".join(p for p in [*parts, self._words(text[at:])] if p)

    def __call__(self, text: str) -> list[str]:
        joined = self.joined(text)
        return joined.split(" ") if joined else []


class WordEncoder:
    """Ids of single words, by the tokenizer's model alone."""

    def __init__(self, path: str):
        # The tasks fill the cores already; threads of the library would each hold memory of their own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer(Tokenizer.from_file(path).model)
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def __call__(self, words: list[str]) -> list[list[int]]:
        found = self.model.encode_batch_fast([w if w[:1] != "\t" else "" for w in words], add_special_tokens=False)
        return [e.ids if w[:1] != "\t" else [int(w[1:])] for w, e in zip(words, found)]


def pieces(path: str) -> list[str]:
    """The piece of each id."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    size = tokenizer.get_vocab_size(with_added_tokens=True)
    if size > MOST_PIECES:
        raise ValueError(f"{size} pieces, over the bound of {MOST_PIECES}")
    return [tokenizer.id_to_token(i) or "" for i in range(size)]


def split_words(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """row (the other columns), words: the words of each text joined by single spaces, compressed."""
    rest = [c for c in docs.columns if c != text]
    kept = F.struct(*[docs[f"`{c}`"] for c in rest]) if rest else F.struct(F.lit(0).alias("_none"))
    rows = docs.select(kept.alias("row"), F.coalesce(docs[text], F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pack = Splitter(path), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            words = [pack.compress(split.joined(t.as_py()).encode()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary())], ["row", "words"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("words", T.BinaryType())]))


def _lean() -> None:
    """In a worker: Arrow's memory is given back when freed, where the usual allocator keeps it for the next block."""
    pa.set_memory_pool(pa.system_memory_pool())


def _unpacked(column: pa.ChunkedArray | pa.Array) -> Iterator[pa.ListArray]:
    """The words of each text, of about CHUNK_BYTES of texts at a time; null for a text without words."""
    unpack, held, size = zstandard.ZstdDecompressor(), [], 0
    for x in column:
        joined = unpack.decompress(x.as_py())
        held.append(joined or None)
        size += len(joined)
        if size >= CHUNK_BYTES:
            yield pc.split_pattern(pa.array(held, pa.string()), " ")
            held, size = [], 0
    if held:
        yield pc.split_pattern(pa.array(held, pa.string()), " ")


def encode(
    docs: DataFrame, path: str, text: str = "text", block_chars: int = BLOCK_CHARS, announce: bool = False
) -> DataFrame:
    """``_row`` (the columns of ``docs`` but the text) and ``ids`` of each text.

    With ``announce`` there is a third column, ``need``, null in these rows; ahead
    of them are rows that hold nothing else, one for each distinct id of a block.
    """
    prepare(docs.sparkSession)
    chars = docs.agg(F.sum(F.octet_length(text)).alias("n")).head()["n"] or 0
    blocks = max(1, -(-chars // block_chars))
    # A block is a hash of the words and the row, so that equal ids or equal texts alone do not meet.
    block = F.pmod(F.xxhash64("words", F.to_json("row")), F.lit(blocks)).cast("int")
    dealt = split_words(docs, path, text).withColumn("block", block).repartition(blocks, "block")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct words of each block, numbered in order; a partition holds few blocks, of bounded size."""
        _lean()
        seen: dict[int, pa.Array] = {}
        for batch in batches:
            of = batch.column("block").to_numpy()
            for b in np.unique(of).tolist():
                found = [seen[b]] if b in seen else []
                found += [pc.unique(lists.flatten()) for lists in _unpacked(batch.column("words").filter(pa.array(of == b)))]
                seen[b] = pc.unique(pa.chunked_array(found))
        for b, names in seen.items():
            names = names.take(pc.sort_indices(names))
            for start in range(0, len(names), 50_000):
                part = names.slice(start, 50_000)
                number = np.arange(start, start + len(part), dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part, pa.array(np.full(len(part), b, np.int32)), pa.array(number)], ["word", "block", "number"]
                )

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by word: a word is encoded at its first row and repeated for its other blocks."""
        _lean()
        encoder, last, last_ids = WordEncoder(path), None, []
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            fresh = names.dictionary.to_pylist()
            ids = encoder([w for w in fresh if w != last])
            if last in fresh:
                ids.insert(fresh.index(last), last_ids)
            last, last_ids = fresh[-1], ids[-1]
            out = pa.array(ids, pa.list_(pa.int32())).take(names.indices)
            held.append((batch.column(1).to_numpy(), batch.column(2).to_numpy(), out))
            if sum(len(h[0]) for h in held) >= PACK_ROWS:
                yield _packed(held)
                held = []
        if held:
            yield _packed(held)

    # All columns go in, though two are read: the exchange is then the one that the other side reads.
    found = dealt.mapInArrow(distinct, "word string, block int, number int")
    found = found.repartition("word").sortWithinPartitions("word").mapInArrow(coded, "block int, codes binary")
    shape = T.StructType([T.StructField("_row", dealt.schema["row"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if announce:
        shape = shape.add("need", T.IntegerType())

    def place(own: pa.Table, codes: pa.Table) -> pa.Table:
        """A block's words replaced by their ids."""
        _lean()
        ends, words = [], []
        for lists in _unpacked(own.column("words")):
            ends.append(np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy()))
            words.append(lists.flatten())
        coded = pa.chunked_array(words, pa.string()).dictionary_encode()
        names = coded.chunk(0).dictionary if coded.num_chunks else pa.array([], pa.string())
        # Words are numbered in order, as in the other pass.
        number = np.empty(len(names), np.int64)
        number[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        start, size, flat = _placed(codes.column("codes"), len(number))
        # Chunks without words are not among the coded ones.
        places = np.concatenate([np.zeros(0, np.int32), *[c.indices.to_numpy() for c in coded.chunks]])
        of = np.split(places, np.cumsum([len(w) for w in words])[:-1])
        del words, coded
        rows, done, out = own.column("row").combine_chunks(), 0, []
        if announce:
            need = pa.array(np.unique(flat), pa.int32())
            out.append([*[pa.nulls(len(need), t) for t in (rows.type, pa.list_(pa.int32()))], need])
        # The result stays in chunks, which go to Spark one at a time.
        for end, chunk in zip(ends, of):
            at = number[chunk]
            n = size[at]
            after = np.append(0, np.cumsum(n))
            values = flat[np.repeat(start[at] - after[:-1], n) + np.arange(after[-1])]
            offsets = after[np.append(0, end)].astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            out.append([rows.slice(done, len(end)), ids, *([pa.nulls(len(end), pa.int32())] if announce else [])])
            done += len(end)
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(x, shape.names) for x in out])

    return dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(place, shape)


def _packed(held: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> pa.RecordBatch:
    """block, codes: of each block the words' numbers, the lengths of their ids, and the ids, compressed."""
    block, number = (np.concatenate([h[k] for h in held]) for k in (0, 1))
    order = np.argsort(block, kind="stable")
    ids = pa.concat_arrays([h[2] for h in held]).take(pa.array(order))
    block, number = block[order], number[order]
    offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
    edges = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block))
    pack = zstandard.ZstdCompressor(level=1)
    codes = []
    for i, j in zip(edges[:-1], edges[1:]):
        parts = [[j - i], number[i:j], np.diff(offsets[i : j + 1]), flat[offsets[i] : offsets[j]]]
        # Bytes of equal rank stand together, which packs small numbers well.
        raw = np.concatenate(parts).astype("<i4").view(np.uint8).reshape(-1, 4).T
        codes.append(pack.compress(np.ascontiguousarray(raw).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(block[edges[:-1]].astype(np.int32)), pa.array(codes, pa.binary())], ["block", "codes"])


def _placed(column: pa.ChunkedArray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By word number: place and number of its ids in the third array."""
    unpack = zstandard.ZstdDecompressor()
    start, size = np.zeros(words, np.int64), np.zeros(words, np.int64)
    flats, base = [np.zeros(0, np.int32)], 0
    for x in column:
        raw = np.frombuffer(unpack.decompress(x.as_py()), np.uint8).reshape(4, -1).T
        raw = np.ascontiguousarray(raw).view("<i4").ravel()
        n = int(raw[0])
        number, length, flat = raw[1 : n + 1], raw[n + 1 : 2 * n + 1], raw[2 * n + 1 :]
        start[number] = base + np.cumsum(length) - length
        size[number] = length
        flats.append(flat)
        base += len(flat)
    return start, size, np.concatenate(flats)


def decode(rows: DataFrame, path: str, need: str | None = None) -> DataFrame:
    """``rows`` with ``decoded``, the text of its ``ids``: each id's piece from the table, joined by spaces.

    ``need`` names the column of ids that ``rows`` announce as ``encode`` does: all of a row's ids
    go ahead of it, in its partition. These rows and the column are not in the result.
    """
    spark = rows.sparkSession
    prepare(spark)
    names = pieces(path)
    size = len(names)
    table = spark.createDataFrame(pa.table({"number": pa.array(range(size), pa.int32()), "piece": pa.array(names, pa.string())}))
    result = [c for c in rows.columns if c not in ("decoded", need)]
    rest = [c for c in result if c != "ids"]
    kept = F.struct(*[rows[f"`{c}`"] for c in rest]) if rest else F.struct(F.lit(0).alias("_none"))
    given = rows.select(kept.alias("row"), rows["ids"].cast("array<int>").alias("ids"), *([rows[need].alias("id")] if need else []))

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids not met before in the partition, each in a row ahead of the rows of its batch."""
        _lean()
        met = np.zeros(size, bool)
        for batch in batches:
            ids = batch.column(1).flatten().fill_null(-1).to_numpy()
            now = np.zeros(size, bool)
            now[ids[(ids >= 0) & (ids < size)]] = True
            fresh = np.flatnonzero(now & ~met).astype(np.int32)
            met |= now
            none = [pa.nulls(len(fresh), batch.column(k).type) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*none, pa.array(fresh)], ["row", "ids", "id"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.int32())], ["row", "ids", "id"])

    if not need:
        row = T.StructField("row", given.schema["row"].dataType)
        given = given.mapInArrow(ahead, T.StructType([row, given.schema["ids"], T.StructField("id", T.IntegerType())]))
    joined = given.join(F.broadcast(table), F.col("id") == F.col("number"), "left").select("row", "ids", "id", "piece")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _lean()
        piece = np.full(size, None, object)
        for batch in batches:
            named = batch.filter(batch.column(3).is_valid())
            piece[named.column(2).to_numpy()] = named.column(3).to_pylist()
            own = batch.filter(batch.column(2).is_null())
            texts = []
            for x in own.column(1):
                ids = x.values.fill_null(-1).to_numpy() if x.is_valid else None
                # A piece that has not come is None, which cannot be joined: the task would fail.
                texts.append(None if ids is None else " ".join(piece[ids[(ids >= 0) & (ids < size)]].tolist()))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(texts, pa.string())], ["row", "ids", "decoded"])

    out = joined.mapInArrow(place, T.StructType([
        joined.schema["row"], joined.schema["ids"], T.StructField("decoded", T.StringType()),
    ]))
    columns = [F.col("ids") if c == "ids" else F.col("row").getField(c).alias(c) for c in result]
    return out.select(*columns, "decoded")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    both = decode(encode(docs.select("doc_id", "text"), path, announce=True), path, need="need")
    joined = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return both.select(
        F.col("_row.doc_id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
