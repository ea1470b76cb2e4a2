"""WARC archives compressed record by record with an embedded Zstandard dictionary.

``write`` turns pages into WARC 1.1 records and writes one archive per task:

* a leading skippable frame (magic 0x184D2A5D) that holds the dictionary,
* then every record as a Zstandard frame of its own, so that any of them can be
  read by its offset with the dictionary alone.

The dictionary is trained on at most ``SAMPLE_RECORDS`` of the response records,
``SAMPLE_BYTES`` together, chosen by a hash of the payload; records beyond
``SAMPLE_RECORD`` bytes stay out of the sample only. Every record is archived.
Where the sample is too small to train on, archives carry no dictionary frame.

Of pages with equal payloads (SHA-256) of at least ``least`` bytes the one with
the smallest page_id becomes a ``response`` record, the others ``revisit``
records that point to it and hold no payload. The rows are
written once with their hashes and a number, so that every later pass sees the
same ones. The decision is made on ids and hashes; the payloads are shuffled at
most once, and not at all while the table of repeated payloads is small enough
to be broadcast (its size is checked).

The files are written by Spark's text writer, which commits them whole and
reaches every file system Spark reaches: a frame is a line, and an empty
skippable frame (magic 0x184D2A50), which decoders pass over, is the line
separator. ``read`` gives the records back with their archive and offset.

Defined results: a null html is the empty payload. A page with a null id is
archived without an id, and comes last among equal payloads. Rows that repeat an
id are records of their own; of those with equal payload one is the response. A
null url is written as ``unknown:``. White space and control characters of a url
are percent-encoded. An empty table gives an empty folder and no records. Other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import prepare
from parlance.session import lookup_join, materialize, scratch_path
from parlance.sources.tables import exists

# Magic numbers of skippable frames. A dictionary's frame has one of its own.
DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
SEPARATOR = b"\x50\x2a\x4d\x18" + bytes(4)
# Fixed value: what a revisit record says about its kind.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY_BYTES, LEVEL = 112_640, 6
SAMPLE_RECORDS, SAMPLE_BYTES, SAMPLE_RECORD = 4_000, 8 << 20, 128 << 10
DATE = "1970-01-01T00:00:00Z"
READ_STEP = 16 << 10

_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:parlance:warc")
_UNSAFE = re.compile(r"[\x00-\x20\x7f-\xa0  ]")
RECORD = (
    "archive string, offset long, length long, record_id string, record_type string, page_id long, url string, "
    "payload_bytes long, payload_digest string, refers_to long, refers_to_record string, payload binary, sound boolean"
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, '/'.join(map(str, parts)))}>"


def safe_url(url: str | None) -> str:
    return _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else "unknown:"


def record(name: str, page_id: int | None, url: str | None, payload: bytes, refers: tuple[str, int | None] | None,
           date: str = DATE) -> bytes:
    """One WARC record; ``refers`` (record id, page id) makes it a revisit."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", name)]
    if page_id is not None:
        fields.append(("X-Page-ID", page_id))
    fields += [("WARC-Target-URI", safe_url(url)), ("WARC-Date", date),
               ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}")]
    if refers:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers[0])]
        if refers[1] is not None:
            fields.append(("X-Refers-To-Page-ID", refers[1]))
    else:
        block += payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of a record, its payload, and whether digest and lengths fit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?m)^Content-Length: (\d+)", http)[1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    sound = version == "WARC/1.1" and rest[len(block):] == b"\r\n\r\n"
    if kind == "response":
        sound = sound and len(payload) == size and base32_sha1(payload) == digest
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "record_id": fields["WARC-Record-ID"], "record_type": kind, "page_id": number("X-Page-ID"),
        "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest,
        "refers_to": number("X-Refers-To-Page-ID"), "refers_to_record": fields.get("WARC-Refers-To"),
        "payload": payload if kind == "response" else None, "sound": sound,
    }


def frames(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """offset, length and content of every record frame of an archive."""
    view, at, decoder = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        magic = bytes(view[at : at + 4])
        if magic[1:] == DICTIONARY_MAGIC[1:] and 0x50 <= magic[0] <= 0x5F:
            size = int.from_bytes(view[at + 4 : at + 8], "little")
            if magic == DICTIONARY_MAGIC and at == 0:
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[8 : 8 + size])))
            at += 8 + size
            continue
        reader, start, out = decoder.decompressobj(), at, []
        while not reader.eof:
            if at >= len(view):
                raise ValueError(f"frame at {start} is cut off")
            out.append(reader.decompress(view[at : at + READ_STEP]))
            at = min(at + READ_STEP, len(view))
        at -= len(reader.unused_data)
        yield start, at - start, b"".join(out)


def train(samples: list[bytes], size: int = DICTIONARY_BYTES, level: int = LEVEL) -> bytes:
    """A dictionary of the samples; empty where they are too few."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples, level=level).as_bytes()
    except zstandard.ZstdError:
        return b""


def keyed(pages: DataFrame) -> DataFrame:
    """_row, page_id, url, payload, its bytes n, _key. ``_row`` tells repeated ids apart."""
    rows = pages.select(
        F.monotonically_increasing_id().alias("_row"), F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    return materialize(rows.withColumn("n", F.length("payload")).withColumn("_key", F.sha2("payload", 256)), "keyed-pages")


def decided(rows: DataFrame, least: int = 0) -> DataFrame:
    """``keyed`` rows with refers, the response's page_id, and revisit."""
    # Reads ids and hashes only, and counts before the shuffle: a hot payload is one row per task.
    place = F.struct(F.col("page_id").isNull().alias("absent"), "page_id", "_row")
    repeated = materialize(
        rows.where(F.col("n") >= least).groupBy("_key")
        .agg(F.count("*").alias("copies"), F.min(place).alias("first")).where("copies > 1")
        .select("_key", F.col("first.page_id").alias("refers"), F.col("first._row").alias("_first")),
        "repeated-payloads",
    )
    joined = lookup_join(rows, repeated, ["_key"], "left", F.col("_row"))
    return joined.withColumn("revisit", F.coalesce(F.col("_first") != F.col("_row"), F.lit(False)))


def sampled(rows: DataFrame) -> list[bytes]:
    """Response records for the dictionary: within the three bounds, in the order of the payloads' hashes."""
    small = rows.where(~F.col("revisit") & (F.col("n") <= SAMPLE_RECORD))
    first = small.select("_key", "n").distinct().orderBy("_key").limit(SAMPLE_RECORDS).collect()
    last, total = None, 0
    for r in first:
        total += r["n"] + 512
        if total > SAMPLE_BYTES:
            break
        last = r["_key"]
    if last is None:
        return []
    # Equal payloads below ``least`` bytes are responses each: one of them.
    table = small.where(F.col("_key") <= last).groupBy("_key").agg(
        F.min("page_id").alias("page_id"), F.min("url").alias("url"), F.min("payload").alias("payload")
    ).orderBy("_key").toArrow()
    return [record(record_id(r["_key"]), r["page_id"], r["url"], r["payload"], None) for r in table.to_pylist()]


def write(pages: DataFrame, folder: str, least: int = 0, level: int = LEVEL, date: str = DATE) -> None:
    """Archives of ``pages`` (page_id, url, html) as files of ``folder``."""
    prepare(pages.sparkSession)
    rows = decided(keyed(pages), least)
    dictionary = train(sampled(rows), level=level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if shared:
            shared.precompute_compress(level)
        encoder = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True, write_content_size=True)
        leading = DICTIONARY_MAGIC + len(dictionary).to_bytes(4, "little") + dictionary if dictionary else None
        for batch in batches:
            out = [leading] if leading and batch.num_rows else []
            leading = None if out else leading
            for r in batch.to_pylist():
                if r["revisit"]:
                    name, refers = record_id(r["_key"], r["page_id"], r["_row"]), (record_id(r["_key"]), r["refers"])
                else:
                    alone = len(r["payload"]) >= least
                    name, refers = record_id(r["_key"]) if alone else record_id(r["_key"], r["page_id"], r["_row"]), None
                out.append(encoder.compress(record(name, r["page_id"], r["url"], r["payload"], refers, date)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    need = rows.select("_row", "page_id", "url", "payload", "_key", "refers", "revisit")
    frames_of = need.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
    frames_of.write.option("lineSep", SEPARATOR.decode()).text(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records (columns of ``RECORD``) of all archives of a folder; ``sound`` tells whether digest and lengths fit."""
    prepare(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, held, size = None, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                path = batch.column(0)[i].as_py()
                for offset, length, data in frames(batch.column(1)[i].as_buffer()):
                    held.append({"archive": path, "offset": offset, "length": length, **parse(data)})
                    size += len(data)
                    if size >= 4 << 20 or len(held) >= 4096:
                        yield pa.RecordBatch.from_pylist(held, schema=_SHAPE)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_SHAPE)

    return files.mapInArrow(run, RECORD)


_SHAPE = pa.schema([
    ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()),
    ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("refers_to_record", pa.string()),
    ("payload", pa.binary()), ("sound", pa.bool_()),
])


def archived(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write the archives, then read them back: a row per record."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    write(pages, folder, least)
    if not exists(spark, folder):
        return spark.createDataFrame([], RECORD)
    return read(spark, folder)
