"""Media columns: texts as animated GIFs, and GIFs as timed frames with colour histograms.

The writer lays bytes out as 8-bit palette indices (a grey palette, 24 pixels wide, frames of
up to 96 rows) and packs each frame with variable-width LZW. Frames take the disposal methods (keep,
clear, restore) in turn, and index 255, which only the padding has, is transparent in the last
one. The reader takes any GIF87a or GIF89a: global and local palettes, interlacing, extensions,
transparency, the disposal methods, clear codes anywhere; a truncated or malformed file is an error
naming the place. :func:`decode` gives composed canvases; of them, tables keep the histograms.

A null text counts as empty; an empty one is one 24 x 24 frame of bytes 255. Repeated rows get
equal files; extra columns never matter; an empty table gives an empty result. Texts are whole:
work and memory are per row, and a row's grow with its text.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bound_batches, only, pick, table

WIDTH, TILE = 24, 576
#: A frame has up to so many 24 x 24 tiles, one below the other.
FRAME_TILES = 4
DELAY_CS = 10
#: The byte that fills a payload up, and the transparent index of its last frame.
PAD = 255
HIST_BINS = 8
_MAX_CODES = 4096


def _widths(min_size: int) -> np.ndarray:
    """Bits of the i-th code after a clear code."""
    clear = 1 << min_size
    n = np.arange(_MAX_CODES * 2)
    entries = np.minimum(clear + 2 + np.maximum(n - 1, 0), 4095)
    return np.maximum(np.floor(np.log2(entries)).astype(np.int64) + 1, min_size + 1)


_WIDTHS = {m: _widths(m) for m in range(1, 12)}
_OFFSETS = {m: np.concatenate([[0], np.cumsum(w)]) for m, w in _WIDTHS.items()}
#: Bits of codes with a full table, and where each begins, a block of them at a time.
_FULL = np.full(_MAX_CODES * 2, 12)
_FULL_OFFSETS = np.arange(len(_FULL) + 1) * 12


def lzw_encode(data: bytes, min_size: int = 8) -> bytes:
    """A GIF code stream of palette indices, with clear codes at the start and before the table could be full."""
    clear = 1 << min_size
    base, widths = clear + 2, _WIDTHS[min_size]
    codes, parts = [], []
    room = _MAX_CODES - base
    at = 0
    while at < len(data):  # a part makes at most one entry a byte, so none outgrows the table
        known: dict[int, int] = {}
        entry, new, segment = known.setdefault, base, []
        put = segment.append
        part = data[at : at + room]
        w = part[0]
        for b in part[1:]:
            c = entry(w << 8 | b, new)
            if c == new:
                put(w)
                new += 1
                w = b
            else:
                w = c
        put(w)
        parts.append(segment)
        at += room
    parts = parts or [[]]
    sizes = []
    for i, segment in enumerate(parts):
        codes.append(clear)
        sizes.append(widths[:1] if i == 0 else widths[len(parts[i - 1]) : len(parts[i - 1]) + 1])
        codes.extend(segment)
        sizes.append(widths[: len(segment)])
    codes.append(clear + 1)
    sizes.append(widths[len(parts[-1]) : len(parts[-1]) + 1])
    c, n = np.array(codes, np.int64), np.concatenate(sizes)
    ends = np.cumsum(n)
    bit = ends - n
    byte, value, size = bit >> 3, c << (bit & 7), int(ends[-1] + 7) // 8
    out = np.bincount(byte, value & 255, size + 2) + np.bincount(byte + 1, value >> 8 & 255, size + 2) + np.bincount(byte + 2, value >> 16, size + 2)
    return out[:size].astype(np.uint8).tobytes()


def _codes(stream: bytes, min_size: int):
    """The codes between clear codes, a list for each such part, up to the end code."""
    clear = 1 << min_size
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.int64)
    total, at = len(stream) * 8, 0
    while True:
        parts = []
        while True:  # after the first block the table is full, and codes have all their bits
            widths, offsets = (_WIDTHS[min_size], _OFFSETS[min_size]) if not parts else (_FULL, _FULL_OFFSETS)
            n = min(int(np.searchsorted(offsets, total - at, "right")) - 1, len(widths))
            if n <= 0:
                raise ValueError("a code stream ends without its end code")
            bit = at + offsets[:n]
            byte = bit >> 3
            code = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (bit & 7)) & ((1 << widths[:n]) - 1)
            stops = np.flatnonzero((code == clear) | (code == clear + 1))
            if stops.size:
                break
            if n < len(widths):
                raise ValueError("a code stream ends without its end code")
            parts.append(code)
            at += int(offsets[n])
        stop = int(stops[0])
        yield np.concatenate([*parts, code[:stop]]) if parts else code[:stop]
        if code[stop] == clear + 1:
            return
        at += int(offsets[stop] + widths[stop])


def _expand(codes: np.ndarray, base: int) -> bytes:
    """The indices that the codes after one clear code stand for.

    Code number k defines entry base + k: its own string and the first index of the next, which
    lie side by side in the output. So every output position of a code that stands for entry j
    copies a position from where code j's output begins; the copies' chains are followed all at
    once, halving their length each time, down to the codes that are plain indices.
    """
    k = np.arange(len(codes))
    made = codes >= base
    source = np.where(made, codes - base, k)
    if (made & (source >= k)).any():
        raise ValueError("a code isn't defined yet")
    length, up = made.astype(np.int64), source
    while True:
        nxt = up[up]
        length = length + length[up]
        if (nxt == up).all():
            break
        up = nxt
    length += 1
    ends = np.cumsum(length)
    starts = ends - length
    at = np.arange(int(ends[-1])) - np.repeat(starts - starts[source], length)
    while True:
        nxt = at[at]
        if (nxt == at).all():
            break
        at = nxt
    plain = np.zeros(len(at), np.uint8)
    plain[starts[~made]] = codes[~made]
    return plain[at].tobytes()


def lzw_decode(stream: bytes, min_size: int) -> bytes:
    """Palette indices of a GIF code stream."""
    if not 1 <= min_size <= 8:
        raise ValueError(f"a code size of {min_size} bits")
    return b"".join(_expand(c, (1 << min_size) + 2) for c in _codes(stream, min_size) if c.size)


def encode(payload: bytes, delay_cs: int = DELAY_CS) -> bytes:
    """An animated GIF89a whose palette indices, frame by frame, are the payload."""
    if not payload or len(payload) % TILE:
        raise ValueError(f"a payload is a positive multiple of {TILE} bytes")
    step = FRAME_TILES * TILE
    height = min(len(payload), step) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, height, 0xF7, 0, 0), bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))]
    out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0")
    for i in range(0, len(payload), step):
        frame = payload[i : i + step]
        clear = i + step >= len(payload)
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, (1 + i // step % 3) << 2 | clear, delay_cs, PAD if clear else 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, WIDTH, len(frame) // WIDTH, 0, 8))
        stream = lzw_encode(frame)
        out += [b"".join(bytes([len(b := stream[j : j + 255])]) + b for j in range(0, len(stream), 255)), b"\0"]
    out.append(b"\x3b")
    return b"".join(out)


@dataclass
class Frame:
    """One timed frame: its rectangle, its indices and the composed canvas after drawing it."""

    delay_cs: int
    disposal: int
    left: int
    top: int
    width: int
    height: int
    indices: bytes
    canvas: np.ndarray  # height x width x RGBA of the screen
    histogram: list[int]  # HIST_BINS a channel over opaque pixels: red, green, blue


def _histogram(canvas: np.ndarray) -> list[int]:
    seen = canvas[canvas[..., 3] > 0] if not canvas[..., 3].all() else canvas.reshape(-1, 4)
    return [int(n) for ch in range(3) for n in np.bincount(seen[:, ch] >> 5, minlength=HIST_BINS)]


def decode(data: bytes) -> list[Frame]:
    """The frames of a GIF in order."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    try:
        return _decode(data)
    except (struct.error, IndexError) as e:
        raise ValueError(f"the GIF is cut short: {e}") from e


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    size = 2 << (flags & 7)
    if at + 3 * size > len(data):
        raise IndexError("in a palette")
    return np.frombuffer(data, np.uint8, 3 * size, at).reshape(-1, 3), at + 3 * size


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        if at + 1 + n > len(data):
            raise IndexError("in a data block")
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def _rows(height: int) -> np.ndarray:
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def _decode(data: bytes) -> list[Frame]:
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    common, at = _palette(data, 13, flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, clear_index = 0, 0, None
    frames: list[Frame] = []
    while True:
        kind = data[at]
        if kind == 0x3B:
            return frames
        if kind == 0x21:
            label = data[at + 1]
            body, at = _blocks(data, at + 2)
            if label == 0xF9:
                bits, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear_index = bits >> 2 & 7, index if bits & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError(f"an unknown block {kind:#x} at byte {at}")
        left, top, w, h, bits = struct.unpack_from("<HHHHB", data, at + 1)
        own, at = _palette(data, at + 10, bits)
        min_size = data[at]
        stream, at = _blocks(data, at + 1)
        indices = lzw_decode(stream, min_size)
        if len(indices) != w * h:
            raise ValueError(f"a frame of {w} x {h} has {len(indices)} pixels")
        if left + w > width or top + h > height:
            raise ValueError("a frame lies outside the screen")
        palette = common if own is None else own
        if palette is None:
            raise ValueError("a frame without a palette")
        pixels = np.frombuffer(indices, np.uint8).reshape(h, w)
        if bits & 0x40:
            ordered = np.empty_like(pixels)
            ordered[_rows(h)] = pixels
            pixels, indices = ordered, ordered.tobytes()
        if pixels.size and int(pixels.max()) >= len(palette):
            raise ValueError("a pixel has no colour")
        before = canvas.copy() if disposal == 3 else None
        region = canvas[top : top + h, left : left + w]
        drawn = np.concatenate([palette, np.full((len(palette), 1), 255, np.uint8)], axis=1)[pixels]
        if clear_index is None:
            region[...] = drawn
        else:
            np.copyto(region, drawn, where=(pixels != clear_index)[..., None])
        frames.append(Frame(delay, disposal, left, top, w, h, indices, canvas.copy(), _histogram(canvas)))
        if disposal == 2:
            region[...] = 0
        elif before is not None:
            canvas = before
        delay, disposal, clear_index = 0, 0, None


def payload_of(text: str | None) -> bytes:
    """The UTF-8 bytes, with bytes 255 up to a positive multiple of 576."""
    raw = (text or "").encode()
    return raw + bytes([PAD]) * (max(TILE, -(-len(raw) // TILE) * TILE) - len(raw))


def store(df: DataFrame, column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep``, n_bytes (of the text, long) and gif (binary) of every row."""
    cols = only(df, *keep, column).withColumn(column, F.col(column).cast("string"))

    def run(batches):
        for batch in batches:
            texts = batch.column(len(keep))
            raw = [encode(payload_of(t.as_py())) for t in texts]
            sizes = pa.array([len((t.as_py() or "").encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], sizes, pa.array(raw, pa.binary())], names=[*keep, "n_bytes", "gif"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in cols.schema.fields[:-1])
    return cols.mapInArrow(run, f"{kept}n_bytes long, gif binary")


FRAMES = "array<struct<delay_cs:int,disposal:int,left:int,top:int,width:int,height:int,histogram:array<int>>>"
_FRAMES = pa.list_(pa.struct([*[pa.field(n, pa.int32()) for n in ("delay_cs", "disposal", "left", "top", "width", "height")], pa.field("histogram", pa.list_(pa.int32()))]))


def read(df: DataFrame, column: str = "gif") -> DataFrame:
    """Replace ``column`` by ``frames`` (timed frames with colour histograms) and ``samples``
    (binary: all frames' palette indices). A null file has no frames and null samples."""
    keep = [f for f in df.schema.fields if f.name != column]

    def run(batches):
        for batch in batches:
            frames, samples = [], []
            for cell in batch.column(batch.schema.get_field_index(column)):
                data = cell.as_py()
                found = decode(data) if data is not None else []
                frames.append([{"delay_cs": f.delay_cs, "disposal": f.disposal, "left": f.left, "top": f.top, "width": f.width, "height": f.height, "histogram": f.histogram} for f in found])
                samples.append(None if data is None else b"".join(f.indices for f in found))
            cols = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(frames, _FRAMES), pa.array(samples, pa.binary())], names=[*[f.name for f in keep], "frames", "samples"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    return df.mapInArrow(run, f"{kept}frames {FRAMES}, samples binary")


def media(docs: DataFrame) -> DataFrame:
    """Digests of every document's GIF and of what is read back from it.

    ``feature``: number of frames, their time in hundredths of a second, and the frames' red
    histograms summed (the palette is grey), colon- and comma-separated.
    """
    bound_batches(docs.sparkSession)
    stored = store(pick(docs, "doc_id long", "text string"), keep=("doc_id",))
    stored = stored.select("doc_id", "n_bytes", F.octet_length("gif").cast("long").alias("media_bytes"), F.sha2("gif", 256).alias("media_sha256"), "gif")
    back = read(stored)
    total = F.transform(
        F.sequence(F.lit(0), F.lit(HIST_BINS - 1)),
        lambda i: F.aggregate("frames", F.lit(0).cast("long"), lambda acc, f: acc + f["histogram"][i]).cast("string"),
    )
    time = F.aggregate("frames", F.lit(0).cast("long"), lambda acc, f: acc + f["delay_cs"])
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -32)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.concat_ws(":", F.size("frames").cast("string"), time.cast("string"), F.array_join(total, ",")).alias("feature"),
    )


def op10_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(table(spark, sf_dir, "documents"))


QUERIES = {"op10_gif": op10_gif}
ORACLE: dict[str, str] = {}
