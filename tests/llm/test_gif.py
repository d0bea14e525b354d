import hashlib
import os
import random
import struct
import zlib

import numpy as np
import pytest

from seekstone.llm import gif

from .common import awkward, empty


def codes_by_the_book(stream, min_size):
    """A plain LZW reader, code by code."""
    clear, out, bits, have, i = 1 << min_size, b"", 0, 0, 0
    table, width, last = [], min_size + 1, None
    while True:
        while have < width:
            bits |= stream[i] << have
            have, i = have + 8, i + 1
        code, bits, have = bits & ((1 << width) - 1), bits >> width, have - width
        if code == clear:
            table, width, last = [bytes([j]) for j in range(clear)] + [b"", b""], min_size + 1, None
            continue
        if code == clear + 1:
            return out
        entry = table[code] if code < len(table) else last + last[:1]
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
        out, last = out + entry, entry


def test_lzw():
    rng = random.Random(1)
    for n in (0, 1, 2, 576, 4000, 20_000):
        for data in (os.urandom(n), bytes(rng.choice(b"ab") for _ in range(n)), b"\0" * n):
            packed = gif.lzw_encode(data)
            assert gif.lzw_decode(packed, 8) == data == codes_by_the_book(packed, 8)


def deferred(codes, min_size, end=True):
    """Codes packed with one clear code at the start only."""
    value, at, n = 1 << min_size, min_size + 1, 0
    for c in codes + [(1 << min_size) + 1] * end:
        width = max(min_size + 1, min((1 << min_size) + 2 + max(n - 1, 0), 4095).bit_length())
        value, at, n = value | c << at, at + width, n + 1
    return value.to_bytes(-(-at // 8), "little")


def test_full_table():
    """Codes run on with a full table beyond any bound, up to a clear code or the end."""
    rng = random.Random(2)
    for n in (8191, 8192, 8193, 16_384, 20_000):
        codes = [rng.randrange(256) for _ in range(5000)] + [rng.choice((rng.randrange(256), rng.randrange(258, 4096))) for _ in range(n - 5000)]
        packed = deferred(codes, 8)
        assert gif.lzw_decode(packed, 8) == codes_by_the_book(packed, 8)
        with pytest.raises(ValueError):
            gif.lzw_decode(deferred(codes, 8, end=False), 8)


def picture(frames, palette=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)), size=(2, 2)):
    out = [b"GIF89a", struct.pack("<HHBBB", *size, 0x81, 0, 0), b"".join(map(bytes, palette))]
    for (left, top, w, h), pixels, disposal, clear, interlaced in frames:
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), 5, clear or 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, left, top, w, h, 0x40 * interlaced, 2))
        stream = gif.lzw_encode(bytes(pixels), 2)
        out.append(bytes([len(stream)]) + stream + b"\0")
    return b"".join(out) + b"\x3b"


def colours(frame):
    return frame.canvas[..., :3].reshape(-1, 3).tolist(), frame.canvas[..., 3].ravel().tolist()


def test_disposal_and_transparency():
    whole = (0, 0, 2, 2)
    a = gif.decode(picture([(whole, [1, 1, 1, 1], 1, None, 0), ((0, 0, 1, 2), [2, 0], 2, 0, 0), ((1, 1, 1, 1), [3], 3, None, 0), ((0, 0, 1, 1), [3], 0, None, 0)]))
    red, green, blue, none = [255, 0, 0], [0, 255, 0], [0, 0, 255], [0, 0, 0]
    assert colours(a[0]) == ([red] * 4, [255] * 4) and colours(a[1])[0] == [green, red, red, red]
    assert colours(a[2]) == ([none, red, none, blue], [0, 255, 0, 255])  # the second frame's rectangle was cleared
    assert colours(a[3]) == ([blue, red, none, red], [255, 255, 0, 255])  # the third frame was undone
    assert [f.delay_cs for f in a] == [5] * 4 and a[2].histogram[7] == 1 and sum(a[2].histogram) == 6


def test_interlaced_and_broken():
    rows = [0, 4, 2, 1, 3]
    f = gif.decode(picture([((0, 0, 1, 5), [r % 4 for r in rows], 0, None, 1)], size=(1, 5)))[0]
    assert list(f.indices) == [0, 1, 2, 3, 0]
    good = picture([((0, 0, 2, 2), [0, 1, 2, 3], 0, None, 0)])
    for bad in (b"", b"GIF88a", good[:20], good[:-4], good[:14], picture([((1, 0, 2, 2), [0] * 4, 0, None, 0)]), picture([((0, 0, 2, 2), [0] * 3, 0, None, 0)])):
        with pytest.raises(ValueError):
            gif.decode(bad)


def test_own_files_use_disposal_and_transparency():
    """The padding is transparent, frames dispose in turn, and the payload comes back whole."""
    payload = gif.payload_of("".join(chr(33 + i % 90) for i in range(5 * 2304 - 100)))
    frames = gif.decode(gif.encode(payload))
    assert b"".join(f.indices for f in frames) == payload and [f.disposal for f in frames] == [1, 2, 3, 1, 2]
    last = frames[-1]
    before = np.frombuffer(frames[3].indices, np.uint8)[-100:]  # kept, and seen through the padding
    assert last.canvas.reshape(-1, 4)[-100:, 0].tolist() == before.tolist() and (last.canvas[..., 3] == 255).all()
    alone = gif.decode(gif.encode(gif.payload_of("ab")))[0]
    assert alone.canvas[..., 3].ravel().tolist() == [255, 255] + [0] * 574 and sum(alone.histogram) == 6


def test_awkward(spark):
    df = awkward(spark)
    got = gif.media(df).collect()
    want = []
    for r in df.collect():
        raw = (r[1] or "").encode()
        full = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        want.append((str(r[0]), len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by.values()) and gif.media(empty(spark)).count() == 0
    frames = gif.read(gif.store(df, keep=("doc_id",))).where("doc_id = 11").first()["frames"]
    assert len(frames) > 10 and np.sum(frames[0]["histogram"]) == 3 * 24 * 96
