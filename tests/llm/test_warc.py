import glob
import hashlib
import random

import pytest
import zstandard

from parlance.llm import warc
from parlance.llm.queries import op11_warc

PAGES = "page_id long, url string, html string, archive string, payload string, _key string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in rows], PAGES).repartition(3)


def texts(n, seed=1):
    rng = random.Random(seed)
    words = [f"<p>wörd{i}</p>" for i in range(60)]
    return ["<html>" + " ".join(rng.choices(words, k=rng.randint(1, 60))) + f"{i}</html>" for i in range(n)]


def test_pages_come_back(spark, folder):
    htmls = texts(300)
    rows = [(i, f"http://a/{i}", h) for i, h in enumerate(htmls)]
    got = {r["page_id"]: r for r in warc.archived(pages(spark, rows), folder + "/w").collect()}
    assert len(got) == 300
    for i, url, html in rows:
        r, data = got[i], html.encode()
        assert (r["record_type"], r["url"], bytes(r["payload"]), r["payload_bytes"], r["sound"]) == (
            "response", url, data, len(data), True)
        assert r["payload_digest"] == warc.base32_sha1(data)


def test_archive_layout(spark, folder):
    warc.write(pages(spark, [(i, "u", h) for i, h in enumerate(texts(300))]), folder + "/w")
    records = warc.read(spark, folder + "/w").collect()
    files = glob.glob(folder + "/w/part-*")
    assert files and len({r["archive"].removeprefix("file:") for r in records}) == len(files)
    for file in files:
        raw = open(file, "rb").read()
        size = int.from_bytes(raw[4:8], "little")
        assert raw[:4] == warc.DICTIONARY_MAGIC
        dictionary = zstandard.ZstdCompressionDict(raw[8 : 8 + size])
        assert dictionary.dict_id() != 0
        own = [r for r in records if r["archive"].removeprefix("file:") == file]
        whole = b""
        for r in sorted(own, key=lambda r: r["offset"]):
            # Each record can be read alone, by its offset and the dictionary.
            frame = raw[r["offset"] : r["offset"] + r["length"]]
            one = zstandard.ZstdDecompressor(dict_data=dictionary).decompress(frame)
            assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n")
            whole += one
        # A plain decoder reads the file as one stream.
        assert zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(raw, read_across_frames=True).readall() == whole
    assert len({r["record_id"] for r in records}) == 300


def test_dictionary_helps():
    samples = [warc.record("<urn:x>", i, "u", t.encode(), None) for i, t in enumerate(texts(400))]
    dictionary = zstandard.ZstdCompressionDict(warc.train(samples))
    fresh = warc.record("<urn:x>", 9, "u", texts(500, 2)[-1].encode(), None)
    plain = zstandard.ZstdCompressor(level=6).compress(fresh)
    assert len(zstandard.ZstdCompressor(level=6, dict_data=dictionary).compress(fresh)) < len(plain) * 0.7
    assert warc.train([]) == b"" and warc.train([b"x"]) == b""


def expected(rows, least):
    """Type and target of each row, by id (ids are unique here)."""
    first = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h or "", i)
    big = lambda h: len((h or "").encode()) >= least
    return {i: ("revisit", first[h or ""]) if big(h) and first[h or ""] != i else ("response", None) for i, _, h in rows}


@pytest.mark.parametrize("least", [0, 10])
@pytest.mark.parametrize("small", [100_000, 0])
def test_equal_payloads(spark, monkeypatch, least, small):
    monkeypatch.setattr("parlance.session.small_enough", lambda df, rows: df.limit(small + 1).count() <= small)
    hot, rows = "<html>the same page</html>", []
    for i in range(120):
        rows.append((i, f"u{i}", hot if i % 3 == 0 else ["", None, "tiny", f"<html>{i}</html>" * 5][i % 4]))
    rows.append((None, None, hot))
    got = warc.archived(pages(spark, rows), least=least).collect()
    assert len(got) == len(rows)
    assert {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got} == expected(rows, least)
    names = {r["record_id"]: r for r in got}
    assert len(names) == len(rows)
    for r in got:
        assert r["sound"]
        if r["record_type"] == "revisit":
            to = names[r["refers_to_record"]]
            assert (to["page_id"], to["payload_digest"], to["record_type"]) == (
                r["refers_to"], r["payload_digest"], "response")
            assert r["payload"] is None and r["payload_bytes"] == to["payload_bytes"]


def test_odd_pages(spark):
    long = "é" * 2_000_000
    rows = [(7, "a b\r\nWARC-Type: x", "same"), (7, "v", "same"), (7, "v", "same"), (None, None, None), (None, "", ""), (1, "u", long)]
    got = warc.archived(pages(spark, rows)).collect()
    assert len(got) == 6 and all(r["sound"] for r in got)
    kinds = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in got if r["page_id"] == 7)
    assert kinds == [(7, "response", None), (7, "revisit", 7), (7, "revisit", 7)]
    assert sorted(r["record_type"] for r in got if r["page_id"] is None) == ["response", "revisit"]
    assert {r["url"] for r in got} == {"a%20b%0D%0AWARC-Type:%20x", "v", "unknown:", "u"}
    assert [r["payload_bytes"] for r in got if r["page_id"] == 1] == [4_000_000]
    assert warc.archived(pages(spark, rows).limit(0)).collect() == []


def test_damage_is_seen():
    good = warc.record("<urn:x>", 1, "u", b"payload", None)
    assert warc.parse(good)["sound"] and not warc.parse(good.replace(b"payload", b"pAyload"))["sound"]
    packed = zstandard.ZstdCompressor().compress(good)
    assert [d for _, _, d in warc.frames(packed + warc.SEPARATOR + packed)] == [good, good]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.frames(packed[:-3]))


def test_query_holds_every_page(spark, sf):
    got = {r["page_id"]: r for r in op11_warc(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        data = (r["html"] or "").encode()
        assert got[r["page_id"]]["payload_bytes"] == len(data)
        assert got[r["page_id"]]["payload_digest"] == warc.base32_sha1(data)
        assert len(hashlib.sha1(data).digest()) * 8 == len(got[r["page_id"]]["payload_digest"]) * 5
