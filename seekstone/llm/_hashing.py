"""64-bit hashes of the words of many texts at once."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(z: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher: a bijection on 64-bit integers."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def stream64(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers of a fixed sequence."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BYTE = stream64(256, 11)
_PLACE = stream64(256, 12)


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        if n > 1 << 20:  # one huge word: don't keep its table
            return stream64(n, 12)
        _PLACE = stream64(1 << (n - 1).bit_length(), 12)
    return _PLACE


#: Bytes hashed at once, but for longer texts: what fits in a processor's cache.
_AT_ONCE = 50_000


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, in order, and the number of words of each text.

    Words are runs of bytes other than space and \\t \\n \\v \\f \\r.
    """
    parts, start, held = [], 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= _AT_ONCE or i == len(texts) - 1:
            parts.append(_word_hashes(texts[start : i + 1]))
            start, held = i + 1, 0
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    n = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[raw]
    begins = ~space
    begins[1:] &= space[:-1]
    first = np.flatnonzero(begins)
    ends = np.cumsum(sizes + 1)  # each text's end, its separator included
    upto = np.searchsorted(first, ends)
    counts = np.diff(upto, prepend=0)
    if not first.size:
        return np.zeros(0, np.uint64), counts
    last = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    lengths = last - first
    at = np.flatnonzero(~space)
    place = at - np.repeat(first, lengths)
    starts = np.cumsum(lengths) - lengths
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_BYTE[raw[at]] * _places(int(lengths.max()))[place], starts)
        return mix64(h + lengths.astype(np.uint64)), counts
