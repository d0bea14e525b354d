import hashlib
import io
import os
import struct

import pytest
import zstandard

from seekstone.llm import warc
from seekstone.llm._common import new_path

SCHEMA = "page_id long, url string, html string, HTML int, digest string"


def rows():
    big, other = "<p>big</p>" * 150, "<p>é</p>" * 130
    return [(1, "http://a/", big), (7, "http://b/", big), (3, None, big), (2, "http://c/ x", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", big), (None, "u", other), (None, "u", other), (8, "u", "long" * 60_000), (9, "u", "x" * 999), (10, "u", "x" * 999), (11, "u", "y" * 1000), (12, "u", "y" * 1000)]


def expected(data):
    last = {}
    for i, _, h in data:
        if len((h or "").encode()) >= 1000 and i is not None:
            last[h] = max(i, last.get(h, i))
    out = []
    for i, _, h in data:
        raw = (h or "").encode()
        to = last.get(h) if len(raw) >= 1000 else None
        to = None if to == i else to
        out.append((str(i), len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", str(to)))
    return sorted(out)


def test_round_trip(spark):
    data = rows()
    df = spark.createDataFrame([(*r, 1, "d") for r in data], SCHEMA)
    folder = new_path(spark, "warc-test")
    index = warc.write_archives(warc.planned(df), folder)
    for got in (warc.read(spark, folder, index), warc.read(spark, folder)):
        found = got.collect()
        # ids of pages without one are random, and stay null
        assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in found) == expected(data)
        assert all(bytes(r["payload"]) if r["payload_bytes"] else True for r in found if r["record_type"] == "response")
    none = spark.createDataFrame([], SCHEMA)
    folder = new_path(spark, "warc-none")
    assert warc.read(spark, folder, warc.write_archives(warc.planned(none), folder)).count() == 0


def archive(records, more=()):
    out = io.BytesIO()
    warc.write_archive(records, iter(more), out)
    return out.getvalue()


def made(n):
    return [warc.make_record(i, f"http://h/{i}", b"<html>" + b"%d " % i * 200, hashlib.sha1(b"<html>" + b"%d " % i * 200).hexdigest(), None) for i in range(n)]


def test_dictionary_frame():
    raw = archive(made(60), made(70)[60:])
    assert struct.unpack("<I", raw[:4])[0] == 0x184D2A5D
    pages = list(warc.read_pages(io.BytesIO(raw)))
    assert [p["page_id"] for p in pages] == list(range(70)) and pages[3]["payload"] == b"<html>" + b"3 " * 200
    size = struct.unpack("<I", raw[4:8])[0]
    found = zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size])
    plain = struct.pack("<II", 0x184D2A5D, len(found)) + found + raw[8 + size :]  # a dictionary that isn't compressed
    assert len(list(warc.read_pages(io.BytesIO(plain)))) == 70
    with pytest.raises(zstandard.ZstdError):
        list(warc.read_pages(io.BytesIO(raw[8 + size :])))  # without its dictionary
    assert len(list(warc.read_pages(io.BytesIO(archive(made(2)))))) == 2 and not list(warc.frames(io.BytesIO(b"")))


def test_damage():
    raw = archive(made(2))
    for cut in (1, 3, 40, len(raw) - 1):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.read_pages(io.BytesIO(raw[:cut])))
    good = made(1)[0]
    bad = [good[:-1], good[:-4], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"Content-Length: ", b"Content-Length: 1", 1), good.replace(b"<html>", b"<htmx>"), good.replace(b"WARC-Type: response", b"WARC-Type: other"), good + b"x", b"nonsense"]
    for record in bad:
        with pytest.raises(ValueError):
            list(warc.read_pages(io.BytesIO(archive([record]))))


def test_bytes_on_disk(spark, tmp_path):
    """Files begin with the dictionary's frame, and each record is a frame of its own."""
    df = spark.createDataFrame([(i, f"http://h/{i}", f"<html>{i} " + f"{i} word " * 200) for i in range(300)], "page_id long, url string, html string").coalesce(1)
    index = warc.write_archives(warc.planned(df).coalesce(1), str(tmp_path)).collect()
    assert sum(r["records"] for r in index) == 300
    for r in index:
        raw = (tmp_path / r["file"]).read_bytes()
        magic, size = struct.unpack("<II", raw[:8])
        assert magic == 0x184D2A5D
        found = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size]))
        rest, n = raw[8 + size :], 0
        while rest:
            assert rest[:4] == b"\x28\xb5\x2f\xfd"
            one = zstandard.ZstdDecompressor(dict_data=found).decompressobj()
            assert one.decompress(rest).startswith(b"WARC/1.1\r\n")
            rest, n = one.unused_data, n + 1
        assert n == r["records"]


def foreign(kind, block, *more, mime="application/http; msgtype=response"):
    head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:0d4f3c1e-0000-4000-8000-000000000000>", "WARC-Date: 2020-05-01T10:00:00Z", f"Content-Type: {mime}", f"Content-Length: {len(block)}", *more]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archive(spark, tmp_path):
    """An archive made by zstandard alone, with a dictionary, warcinfo and requests, through read()."""
    bodies = [b"<html>page %d</html>" % i + os.urandom(50) for i in range(40)]
    records = [foreign("warcinfo", b"software: other\r\n", mime="application/warc-fields")]
    for i, b in enumerate(bodies):
        digest = [f"WARC-Payload-Digest: sha1:{hashlib.sha1(b).hexdigest()}"] if i % 2 else []
        records.append(foreign("request", b"GET / HTTP/1.1\r\n\r\n", mime="application/http; msgtype=request"))
        records.append(foreign("response", b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + b, f"WARC-Target-URI: http://f/{i}", *digest))
    found = zstandard.train_dictionary(4096, records)
    packer = zstandard.ZstdCompressor(dict_data=found, write_content_size=False)
    raw = found.as_bytes()
    (tmp_path / "a.warc.zst").write_bytes(struct.pack("<II", 0x184D2A5D, len(raw)) + raw + b"".join(map(packer.compress, records)))
    got = {r["url"]: r for r in warc.read(spark, str(tmp_path)).collect()}
    assert len(got) == 40 and all(bytes(got[f"http://f/{i}"]["payload"]) == b and got[f"http://f/{i}"]["payload_digest"] == hashlib.sha1(b).hexdigest() for i, b in enumerate(bodies))


def test_more_repeated_digests_than_are_broadcast(spark, monkeypatch):
    """Digests beyond those broadcast are met by a shuffle, with the same plan of records."""
    pages = [(i, "u", f"{i % 7} " * 600 if i % 3 else "small") for i in range(60)] + [(None, "u", "1 " * 600), (100, "u", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    told = lambda: sorted(map(str, warc.planned(df).select("page_id", "digest", "refers_to").collect()))
    want = told()
    for most in (1, 3):
        monkeypatch.setattr(warc, "BROADCAST_DIGESTS", most)
        assert told() == want and sum("refers_to=None" not in r for r in want) > 20
