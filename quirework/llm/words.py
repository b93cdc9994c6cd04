"""Words and word n-grams of many texts at once, as 64-bit hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text that are turned into arrays at once.
STEP = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the finalizer of a common splittable generator)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = _U(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE, dtype=_U), np.full(n, inverse, dtype=_U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return body[offsets[0]: offsets[-1]], offsets - offsets[0]


def word_spans(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, words' hashes, starts and ends in the bytes, row borders among the words), slice by slice.

    Slices hold the rows in order. Words are the maximal runs of bytes other than space and U+0009 to U+000D, with A-Z lower-cased.
    A slice holds about ``STEP`` bytes, or one text if that is longer.
    """
    body, offsets = _bytes(texts)
    n = len(offsets) - 1
    first, cap = 0, 0
    up = down = np.zeros(0, dtype=_U)
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + STEP, "right")) - 1)
        lo, hi = int(offsets[first]), int(offsets[last])
        part, at = body[lo:hi], offsets[first: last + 1] - lo
        if len(part) == 0:
            none = np.zeros(0, dtype=np.int64)
            yield part, none.astype(_U), none, none, np.zeros(last - first + 1, dtype=np.int64)
            first = last
            continue
        if len(part) + 1 > cap:
            cap = max(len(part) + 1, STEP + 1)
            up, down = _powers(cap)
        inside = ~_SPACE[part]
        edge = np.ones(len(part) + 1, dtype=bool)
        edge[1:-1] = ~(inside[1:] & inside[:-1])
        edge[at] = True
        starts = np.flatnonzero(inside & edge[:-1])
        ends = np.flatnonzero(inside & edge[1:]) + 1
        total = np.zeros(len(part) + 1, dtype=_U)
        np.cumsum((_LOWER[part].astype(_U) + _U(1)) * up[: len(part)], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * down[starts])
        yield part, hashes, starts, ends, np.searchsorted(starts, at)
        first = last


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word sequences of one text; of the whole sequence where it is shorter."""
    if len(words) == 0:
        return words
    k = min(n, len(words))
    count = len(words) - k + 1
    total = np.full(count, _U(k), dtype=_U)
    for i in range(k):
        total = mix(total * _U(0xD6E8FEB86659FD93) + words[i: i + count])
    return total
