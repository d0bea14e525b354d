"""Byte-level BPE encoding and decoding with a segment tree.

A piece (one match of the split pattern) is merged over its byte positions. Leaf i of a
segment tree holds ``rank * size + i`` for the pair of live tokens that begins at byte i, so
the root is the leftmost pair of least rank; a merge changes three leaves (the pair itself,
its left neighbour and the absorbed token) and their paths to the root. Short pieces are
merged side by side, one numpy column each; longer ones one by one.

Texts: null counts as empty; empty texts have no ids. Repeated rows get equal results. Texts are whole: long ones are
split into pieces a part at a time, and their ids are held by one task. An empty table gives an empty
result. Extra columns stay, whatever their names: one that differs from ``ids`` or ``n_tokens`` in case only
stands beside it.
"""

from __future__ import annotations

import base64
import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bound_batches, pack, pick, table

#: Pieces of up to so many bytes are merged in columns.
COLUMN_BYTES = 32
#: Pieces in one block of columns; entries that a worker's cache holds before it is emptied.
BLOCK, CACHE = 16_384, 400_000
#: Texts longer than this are split into pieces a part at a time.
LONG_TEXT, LONG_PIECES = 2_000_000, 200_000
_NONE = np.int64(1) << 60


class Codec:
    """Ranks, pair table and cache of one vocabulary, as raw ``.tiktoken`` bytes."""

    def __init__(self, vocab: bytes, pattern: str):
        lines = (line.split() for line in vocab.splitlines() if line.strip())
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.pattern = regex.compile(pattern)
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing[:5]}")
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append(((left << 32) | right, rank))
        pairs.sort()
        self.pair_keys = np.array([k for k, _ in pairs] + [np.iinfo(np.int64).max], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs] + [-1], np.int64)
        self.pair_rank = dict(pairs)
        size = max(self.ranks.values()) + 1
        by_id: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            by_id[rank] = token
        self.known = np.zeros(size, bool)
        self.known[list(self.ranks.values())] = True
        self.lengths = np.array([len(t) for t in by_id], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(by_id), np.uint8)
        self.cache: dict[str, bytes] = {}

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of token ids, -1 for none; ids below 0 pair with nothing."""
        key = (left << 32) | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], -1)

    def _merge_columns(self, pieces: list[bytes], size: int) -> list[np.ndarray]:
        """Merge pieces of at most ``size`` bytes (a power of two), one column each."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.zeros((n, size), np.uint8)
        raw[np.arange(size) < lengths[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        shift = size.bit_length() - 1
        rows = np.arange(size)[:, None]
        live = rows < lengths
        token = np.full((size + 1, n), -1, np.int64)
        token[:size] = np.where(live, self.byte_ids[raw.T], -1)
        after = np.minimum(np.broadcast_to(rows + 1, (size, n)), lengths).astype(np.int64)
        after[after == lengths] = size
        before = np.broadcast_to(rows - 1, (size, n)).copy()
        tree = np.empty((2 * size, n), np.int64)
        rank = self._rank_of(token[:size].ravel(), token[1:].ravel()).reshape(size, n)
        tree[size:] = np.where(rank >= 0, (rank << shift) | rows, _NONE)
        for top in (1 << k for k in range(shift - 1, -1, -1)):
            tree[top : 2 * top] = np.minimum(tree[2 * top : 4 * top : 2], tree[2 * top + 1 : 4 * top : 2])
        col = np.flatnonzero(tree[1] < _NONE)
        while col.size:
            best = tree[1, col]
            at = best & (size - 1)
            gone = after[at, col]
            nxt = after[gone, col]
            token[at, col] = best >> shift
            token[gone, col] = -1
            after[at, col] = nxt
            inner = nxt < size
            before[nxt[inner], col[inner]] = at[inner]
            tree[size + gone, col] = _NONE
            rank = self._rank_of(token[at, col], token[nxt, col])
            tree[size + at, col] = np.where(rank >= 0, (rank << shift) | at, _NONE)
            left = before[at, col]
            has = left >= 0
            lat, lcol = left[has], col[has]
            rank = self._rank_of(token[lat, lcol], token[at[has], lcol])
            tree[size + lat, lcol] = np.where(rank >= 0, (rank << shift) | lat, _NONE)
            for leaf, c in ((gone, col), (at, col), (lat, lcol)):
                node = (size + leaf) >> 1
                for _ in range(shift):
                    tree[node, c] = np.minimum(tree[2 * node, c], tree[2 * node + 1, c])
                    node = node >> 1
            col = col[tree[1, col] < _NONE]
        ids = token[:size].T
        return [row[row >= 0] for row in ids]

    def merge_one(self, piece: bytes) -> list[int]:
        """The same merges for one piece of any length: n log n steps, lists only."""
        n = len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        none, get = 1 << 62, self.pair_rank.get
        token = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * size)
        for i in range(n - 1):
            rank = get((token[i] << 32) | token[i + 1])
            if rank is not None:
                tree[size + i] = rank * size + i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                value = a if a < b else b
                if tree[k] == value:
                    return
                tree[k] = value
                k >>= 1

        while tree[1] < none:
            rank, at = divmod(tree[1], size)
            gone = after[at]
            nxt = after[gone]
            token[at], token[gone], after[at] = rank, -1, nxt
            put(gone, none)
            new = None
            if nxt < n:
                before[nxt] = at
                new = get((rank << 32) | token[nxt])
            put(at, none if new is None else new * size + at)
            left = before[at]
            if left >= 0:
                new = get((token[left] << 32) | rank)
                put(left, none if new is None else new * size + left)
        return [t for t in token if t >= 0]

    def learn(self, pieces: set[str]) -> None:
        """Put the pieces that the cache lacks into it."""
        classes: dict[int, list[str]] = {}
        for p in pieces:
            raw = p.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.cache[p] = whole.to_bytes(4, "little")
            elif len(raw) > COLUMN_BYTES:
                self.cache[p] = np.array(self.merge_one(raw), "<u4").tobytes()
            else:
                classes.setdefault(1 << (len(raw) - 1).bit_length(), []).append(p)
        for size, found in classes.items():
            for i in range(0, len(found), BLOCK):
                block = found[i : i + BLOCK]
                merged = self._merge_columns([p.encode() for p in block], size)
                self.cache.update((p, ids.astype("<u4").tobytes()) for p, ids in zip(block, merged))

    def encode_pieces(self, lists: list[list[str]]) -> list[bytes]:
        need = set().union(*lists)
        new = need - self.cache.keys()
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = need
        self.learn(new)
        get = self.cache.__getitem__
        return [b"".join(map(get, pieces)) for pieces in lists]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        pending: list[list[str]] = []
        held = 0
        for text in texts:
            text = text or ""
            if len(text) > LONG_TEXT:
                yield from self.encode_pieces(pending)
                pending, held = [], 0
                found = (m.group() for m in self.pattern.finditer(text))
                parts = iter(lambda: list(itertools.islice(found, LONG_PIECES)), [])
                yield b"".join(self.encode_pieces([part])[0] for part in parts)
                continue
            pending.append(self.pattern.findall(text))
            held += len(pending[-1])
            if held > LONG_PIECES:
                yield from self.encode_pieces(pending)
                pending, held = [], 0
        yield from self.encode_pieces(pending)

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes of little-endian ids; an unknown id is an error."""
        if ids and len(ids) % 4:
            raise ValueError("ids are whole 32-bit integers")
        found = np.frombuffer(ids or b"", "<u4").astype(np.int64)
        if found.size and (found.max() >= self.known.size or not self.known[found].all()):
            raise ValueError("an id is not in the vocabulary")
        out = []
        for i in range(0, found.size, 1 << 18):  # bounded index arrays
            part = found[i : i + (1 << 18)]
            n = self.lengths[part]
            ends = np.cumsum(n)
            index = np.arange(ends[-1]) + np.repeat(self.starts[part] - (ends - n), n)
            out.append(self.flat[index].tobytes())
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def codec(vocab: bytes, pattern: str) -> Codec:
    return Codec(vocab, pattern)


def _vocabulary(spark: SparkSession, path: str | None, pattern: str | None):
    """The vocabulary file, read once and broadcast: under 2 MB, whatever the input's size."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        raw = f.read()
    if len(raw) > 16_000_000:
        raise ValueError("a vocabulary of more than 16 MB is not broadcast")
    return spark.sparkContext.broadcast(raw), pattern or public_tokenizers.PATTERN


def _encoded(df: DataFrame, column: str, path: str | None, pattern: str | None, counted: bool) -> DataFrame:
    """The columns of ``df``, then ``ids`` and, if ``counted``, ``n_tokens``; own columns of just these names are replaced.
    Columns go by position throughout, so names that differ in case only do no harm."""
    vocab, pattern = _vocabulary(df.sparkSession, path, pattern)
    packed, names = pack(df, f"{column} string")
    packed = packed.withColumnRenamed(column, "__text")
    made = ["ids", "n_tokens"][: 1 + counted]

    def run(batches):
        c = codec(vocab.value, pattern)
        try:
            for batch in batches:
                ids = list(c.encode(batch.column(1).to_pylist()))
                sizes = [pa.array([len(x) // 4 for x in ids], pa.int64())] if counted else []
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), *sizes], names=["__row", *made])
        finally:
            c.cache.clear()  # the worker may go on to other stages

    row_type = packed.schema["__row"].dataType.simpleString()
    out = packed.mapInArrow(run, f"__row {row_type}, ids binary" + (", n_tokens long" if counted else ""))
    kept = [(i, n) for i, n in enumerate(names) if n not in made]
    return out.select(*[F.col(f"__row.__c{i}").alias(f"__k{i}") for i, _ in kept], *made).toDF(*[n for _, n in kept], *made)


def encode(df: DataFrame, column: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add ``ids`` (binary: little-endian unsigned 32-bit integers) to every row of ``df``.

    Null texts have no ids, as empty ones. Every other column stays as it is; a column of
    the name ``ids`` is replaced.
    """
    return _encoded(df, column, path, pattern, False)


def decode(df: DataFrame, column: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Replace ``column`` (ids as :func:`encode` makes them) by ``decoded`` (binary).

    The other columns must be flat; null ids decode to no bytes.
    """
    vocab, pattern = _vocabulary(df.sparkSession, path, pattern)
    keep = [f for f in df.schema.fields if f.name != column]

    def run(batches):
        c = codec(vocab.value, pattern)
        for batch in batches:
            at = batch.schema.get_field_index(column)
            out = pa.array((c.decode(x) for x in batch.column(at).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in keep] + [out], names=[f.name for f in keep] + ["decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return df.mapInArrow(run, f"{schema}, decoded binary")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, by way of encode and decode."""
    bound_batches(docs.sparkSession)
    ids = encode(pick(docs, "doc_id long", "text string"), path=path)
    told = ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return decode(told, path=path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the columns of the documents, the ids and n_tokens; own columns of just these names are replaced."""
    bound_batches(spark)
    return _encoded(docs, "text", None, None, True)


QUERIES = {"op8_bpe": op8_bpe}
ORACLE: dict[str, str] = {}
