"""WARC archives in Zstandard: a writer, and a reader of the format's dictionary variant.

An archive (``.warc.zst``) begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, itself compressed; each record is one frame compressed with it. The writer trains
a dictionary for each archive on its first records and names no dictionary in files too small for
training; the reader takes archives with and without a dictionary, raw or compressed, decodes
frame by frame, and checks the magic, the headers that every record needs, lengths, separators and
payload digests. Pages are responses and revisits; the standard's other records (warcinfo, request,
metadata and so on) are checked as records and passed over. A response without a SHA-1 digest gets
one; transfer encodings are left as they are. Files are opened without pyarrow's own decompression,
which would take an archive for one stream.

Payloads that are equal and have ``LEAST_REVISIT`` bytes at least are stored once, with the
largest page_id; the others become revisit records (identical-payload-digest) that refer to it.
Defined cases: a null html is an empty payload; rows with a null page_id are responses unless
an equal payload has an id; rows that repeat both are responses all; an empty table gives no
archives and an empty result. Extra columns never matter. Records are whole in memory, one at a time;
one beyond ``MOST_BYTES`` is refused by the reader.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bound_batches, frequent, new_path, pick, table, written

SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
DICT_MAGIC = b"\x37\xa4\x30\xec"
LEAST_REVISIT = 1000
#: Compressed bytes after which the writer begins another archive, and bounds of the dictionary's training.
ROLL_BYTES = 32 << 20
TRAIN_RECORDS, TRAIN_BYTES, DICT_BYTES = 200, 4 << 20, 32 << 10
#: Records may have so many bytes at most (a length beyond it is taken for damage).
MOST_BYTES = 2 << 30
#: Repeated payloads up to this number are broadcast, with about 100 bytes each.
BROADCAST_DIGESTS = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: The standard's record types that hold no page.
NO_PAGES = {"warcinfo", "request", "metadata", "resource", "conversion", "continuation"}


def record_id(page_id: int | None) -> str:
    """A stable record id; pages without an id have random ones."""
    return f"<urn:x-page:{page_id}>" if page_id is not None else f"<{uuid.uuid4().urn}>"


def _digest(sha1_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, sha1_hex: str, refers_to: int | None) -> bytes:
    """One response record, or a revisit record without the payload if refers_to is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    uri = " ".join((url or "about:blank").split()) or "about:blank"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: {_digest(sha1_hex)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archive(records: list[bytes], more: Iterator[bytes], out) -> int:
    """Write records (on which the dictionary is trained) and then more of them; bytes written."""
    found = None
    if len(records) >= 8:
        try:
            found = zstandard.train_dictionary(DICT_BYTES, records)
        except zstandard.ZstdError:  # too little or too uniform to train on
            found = None
    size = 0
    if found is not None:
        raw = zstandard.ZstdCompressor(level=3).compress(found.as_bytes())
        size += out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
    packer = zstandard.ZstdCompressor(level=3, dict_data=found, write_content_size=True, write_checksum=True)
    for group in (records, more):
        for r in group:
            size += out.write(packer.compress(r))
    return size


def _dictionary(f) -> tuple[zstandard.ZstdCompressionDict | None, bytes]:
    """The dictionary of the leading skippable frame, and what was read beyond it."""
    head = f.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != SKIPPABLE:
        return None, head
    size = struct.unpack("<I", head[4:])[0]
    raw = f.read(size)
    if len(raw) < size:
        raise ValueError("the archive ends within its dictionary")
    if raw[:4] == ZSTD_MAGIC:
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=64 << 20)
    if raw[:4] != DICT_MAGIC:
        raise ValueError("the leading frame holds no dictionary")
    return zstandard.ZstdCompressionDict(raw), b""


def frames(f) -> Iterator[bytes]:
    """The contents of an archive's frames in order; memory for one of them at a time."""
    found, rest = _dictionary(f)
    reader = zstandard.ZstdDecompressor(dict_data=found)
    data = rest
    while True:
        if not data:
            data = f.read(1 << 18)
            if not data:
                return
        while len(data) < 4:  # to see the frame's magic
            more = f.read(1 << 18)
            if not more:
                raise ValueError("the archive ends within a frame's magic")
            data += more
        if data[:4] != ZSTD_MAGIC:
            raise ValueError(f"not a frame: {data[:4].hex()}")
        one, parts = reader.decompressobj(), []
        while True:
            parts.append(one.decompress(data))
            if one.eof:
                data = one.unused_data
                break
            data = f.read(1 << 18)
            if not data:
                raise ValueError("the archive ends within a frame")
        yield b"".join(parts)


def parse_record(raw: bytes) -> dict:
    """The named fields and the block of one frame, validated."""
    head, gap, body = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("a record doesn't begin with its version, or has no end of headers")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"a malformed header line {line[:80]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"a record without {name}")
    if not fields["content-length"].isdigit() or int(fields["content-length"]) > MOST_BYTES:
        raise ValueError(f"a content-length of {fields['content-length'][:40]}")
    size = int(fields["content-length"])
    if len(body) != size + 4 or body[size:] != b"\r\n\r\n":
        raise ValueError(f"a record of {len(body)} bytes after its headers says {size}")
    return {"fields": fields, "block": body[:size]}


def _page(urn: str | None) -> int | None:
    return int(urn[12:-1]) if urn and urn.startswith("<urn:x-page:") else None


def read_pages(f) -> Iterator[dict]:
    """page_id, url, record_type, refers_to, payload (None in revisits), payload_bytes and
    payload_digest (hex) of an archive's pages; lengths and digests are checked."""
    for raw in frames(f):
        record = parse_record(raw)
        fields, block = record["fields"], record["block"]
        if fields["warc-type"] in NO_PAGES:
            continue
        http, gap, payload = block.partition(b"\r\n\r\n")
        lines = http.decode("latin-1").split("\r\n")
        if not gap or not lines[0].startswith("HTTP/"):
            raise ValueError("a record without an HTTP head")
        size = next((int(v) for k, _, v in (x.partition(":") for x in lines[1:]) if k.lower() == "content-length"), None)
        kind = fields["warc-type"]
        kept = kind == "response"
        name, _, digest = fields.get("warc-payload-digest", "").partition(":")
        if kind not in ("response", "revisit") or (name.lower() != "sha1" and not kept):
            raise ValueError(f"a record of type {kind} with digest {name[:8]}")
        own = hashlib.sha1(payload).digest()
        sha1 = own if name.lower() != "sha1" else bytes.fromhex(digest) if len(digest) == 40 else base64.b32decode(digest)
        if kept and (size not in (None, len(payload)) or own != sha1):
            raise ValueError(f"record {fields['warc-record-id']}: its payload has another length or digest")
        yield {"page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": _page(fields.get("warc-refers-to")), "payload": payload if kept else None, "payload_bytes": len(payload) if kept else size, "payload_digest": sha1.hex()}


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest (hex SHA-1) and refers_to (null for responses).

    Only ids and digests are grouped. The largest ids of repeated payloads come back by joins on
    the digest: those of the BROADCAST_DIGESTS most frequent ones are broadcast, whatever there is beside them, so
    that such payloads stay where they are read, even if one of them is on a third of all pages; if there are
    more, the other pages are dealt by digest, of which each has few.
    """
    rows = pick(pages, "page_id long", "url string", "html string")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = rows.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    big = rows.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("__last"), F.count("*").alias("__n"))
    big = written(big.where("__n > 1 and __last is not null").select(F.col("digest").alias("__digest"), "__last", "__n"), "warc-repeated")
    few = frequent(big, "__n", "__digest", most=BROADCAST_DIGESTS).select("__digest", "__last")
    told = rows.join(F.broadcast(few), F.col("digest") == F.col("__digest"), "left")
    if big.count() > BROADCAST_DIGESTS:
        rest = big.join(F.broadcast(few.select("__digest")), "__digest", "left_anti").select(F.col("__digest").alias("__rest"), F.col("__last").alias("__other"))
        own = told.where("__digest is not null")
        others = told.where("__digest is null").drop("__last").join(rest, F.col("digest") == F.col("__rest"), "left").withColumnRenamed("__other", "__last")
        told = own.select("page_id", "url", "payload", "digest", "__last").unionByName(others.select("page_id", "url", "payload", "digest", "__last"))
    other = F.when(~F.col("page_id").eqNullSafe(F.col("__last")), F.col("__last"))
    return told.select("page_id", "url", "payload", "digest", other.alias("refers_to"))


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
    return fs, path


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Archives under ``folder``; a written table of file and records, one row an archive.

    Every attempt of a task writes files of new names, and only those that come back in the
    job's result count; so a task that is run again leaves no double records.
    """

    def run(batches):
        fs, top = _filesystem(folder)
        fs.create_dir(top, recursive=True)
        queue = (make_record(*r) for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        while True:
            first, size = [], 0
            for r in queue:
                first.append(r)
                size += len(r)
                if len(first) == TRAIN_RECORDS or size >= TRAIN_BYTES:
                    break
            if not first:
                return
            counted = [len(first)]
            name = f"{top}/{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(name, compression=None) as out:
                counter = _Counter(out)

                def more(counter=counter, counted=counted):
                    while counter.size < ROLL_BYTES:
                        r = next(queue, None)
                        if r is None:
                            return
                        counted[0] += 1
                        yield r

                write_archive(first, more(), counter)
            yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[1]]), pa.array(counted, pa.int64())], names=["file", "records"])

    cols = rows.select("page_id", "url", "payload", "digest", "refers_to")
    return written(cols.mapInArrow(run, "file string, records long"), "warc-index")


class _Counter:
    """A stream that knows how many bytes went through it."""

    def __init__(self, out):
        self.out, self.size = out, 0

    def write(self, data: bytes) -> int:
        self.out.write(data)
        self.size += len(data)
        return len(data)


RECORD = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
_FIELDS = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]


def read(spark: SparkSession, folder: str, index: DataFrame | None = None) -> DataFrame:
    """The records of the archives under ``folder``; with an index (file, records), of just its
    files, whose numbers of records are checked. Each archive is streamed by one task."""
    if index is None:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path")
        index = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.lit(None).cast("long").alias("records"))

    def run(batches):
        fs, top = _filesystem(folder)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, held, size = 0, [], 0
                with fs.open_input_stream(f"{top}/{name}", compression=None) as f:
                    for r in read_pages(f):
                        n += 1
                        held.append(r)
                        size += len(r["payload"] or b"")
                        if size > 8 << 20 or len(held) == 1000:
                            yield _batch(held)
                            held, size = [], 0
                if records is not None and n != records:
                    raise ValueError(f"{name} has {n} records, not {records}")
                if held:
                    yield _batch(held)

    spread = index.select("file", "records").repartition(max(1, spark.sparkContext.defaultParallelism * 4), "file")
    return spread.mapInArrow(run, RECORD)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in _FIELDS], names=[n for n, _ in _FIELDS])


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark, 500)
    folder = new_path(spark, "warc")
    index = write_archives(planned(table(spark, sf_dir, "pages")), folder)
    return read(spark, folder, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to FROM m
"""

QUERIES = {"op7_warc": op7_warc}
ORACLE = {"op7_warc": _SQL}
