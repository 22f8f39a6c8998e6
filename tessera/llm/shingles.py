"""Word shingles of whole texts as 64-bit hashes, computed over Arrow buffers.

A word is a maximal run of bytes other than the six ASCII white-space bytes, after
lower-casing A-Z. A document's set holds its distinct shingles of ``WORDS`` words;
a shorter document has one shingle, its whole word sequence; a document without
words or without text has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
#: Bytes of text handled at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BASE = np.uint64(int(_rng.integers(1 << 62)) * 2 + 1)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
for _c in range(ord("A"), ord("Z") + 1):
    _VALUE[_c] = _VALUE[_c + 32]
_MULT = _rng.integers(1, 1 << 62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for at least ``n`` places."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, factor in enumerate((_BASE, inverse)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of slices of at most ``limit`` bytes (one row at least); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the number of words before each document's start. ``breaks``: which bytes part words."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(breaks[data], out=inside[1:-1])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[(offsets > 0) & (offsets < len(data))]] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[: len(data)], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(starts, offsets, "left")


def sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> Iterator[np.ndarray]:
    """Each document's sorted distinct shingle hashes."""
    hashes, first = word_hashes(data, offsets)
    if len(hashes) >= words:
        joined = np.zeros(len(hashes) - words + 1, np.uint64)
        for k in range(words):
            joined += hashes[k : k + len(joined)] * _MULT[k]
        joined = mix(joined)
    else:
        joined = np.zeros(0, np.uint64)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= words:
            yield np.unique(joined[a : b - words + 1])
        elif b > a:
            yield mix(np.append(hashes[a:b] * _MULT[8 : 8 + b - a], np.uint64(b - a)).sum(keepdims=True, dtype=np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """Two order-free 64-bit digests of a set: equal sets share them."""
    if not len(shingles):
        return 0, 0
    a = mix(shingles + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    b = mix(shingles ^ np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))
