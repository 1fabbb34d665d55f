"""Words of Arrow string columns as numpy arrays of 64-bit hashes, without a Python loop over words.

A batch's UTF-8 bytes are classified by a 256-entry table; a word is a maximal run of
non-separator bytes inside one text. Its hash is a polynomial in random 64-bit byte codes,
from one prefix sum over the bytes, put through a finaliser.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: ``[\x20\x09-\x0D]`` separates words.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: ``[\x00-\x2F\x3A-\x60\x7B-\x7F]`` separates words, upper-case letters being lowered before.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x80] = True
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Bytes hashed at a time; a pass takes some 40 bytes of memory for each.
SEGMENT = 512 << 10

_RNG = np.random.default_rng(20240229)
_CODES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix: a bijection, so equal outputs mean equal inputs."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, min(SEGMENT, 2 * len(_powers[0])))
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts in them; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most about ``most`` bytes; a longer text stands alone."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data`` and the first word of each text (n + 1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~breaks[data]
    edge = inside[1:] != inside[:-1]
    first, last = inside.copy(), inside.copy()
    first[1:] &= edge
    last[:-1] &= edge
    full = offsets[:-1] < offsets[1:]
    a, b = offsets[:-1][full], offsets[1:][full] - 1
    first[a] = inside[a]
    last[b] = inside[b]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, in passes over at most ``SEGMENT`` bytes (more for one longer word)."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        at = starts[k]
        to = max(k + 1, int(np.searchsorted(ends, at + SEGMENT, "right")))
        piece = data[at : ends[to - 1]]
        up, down = _power(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_CODES[piece] * up[: len(piece)], out=total[1:])
        s, e = starts[k:to] - at, ends[k:to] - at
        h = (total[e] - total[s]) * down[s]
        out[k:to] = mix(h ^ ((e - s).astype(np.uint64) << np.uint64(1)))
        k = to
    return out


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = BLANKS, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the first word of each text (n + 1 values)."""
    if lower:
        data = LOWER[data]
    starts, ends, first = spans(data, offsets, breaks)
    return hashes(data, starts, ends), first


def rolling(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hashes of every ``n`` consecutive words (``len(h) - n + 1`` values)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    c = np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    m = len(h) - n + 1
    out = h[:m] * c[0]
    for j in range(1, n):
        out += h[j : j + m] * c[j]
    return mix(out)


def firsts(first: np.ndarray, n: int) -> np.ndarray:
    """For the word ranges that ``first`` bounds: which of all ``rolling(…, n)`` windows stay in one text."""
    total = int(first[-1])
    ok = np.ones(max(0, total - n + 1), bool)
    for j in range(1, n):
        at = first[1:-1] - j
        at = at[(at >= 0) & (at < len(ok))]
        ok[at] = False
    return ok
