"""Content-chosen anchors: of each window's K-grams, the one with the least hash."""

from __future__ import annotations

import numpy as np

from tessera.llm.shingles import _power_tables, mix

_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``digests`` needs of one text."""
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * power[: len(data)], out=sums[1:])
    return sums, inverse


def digests(sums: np.ndarray, inverse: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64-bit digest of each ``[left, right)``; equal bytes have equal digests wherever they stand."""
    return mix((sums[right] - sums[left]) * inverse[left] + (right - left).astype(np.uint64))


def anchors(data: np.ndarray, window: int, k: int, sums: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(positions, hashes)`` of the grams that are least in some window of one document.

    Every run of ``window`` bytes holds an anchor, and equal runs hold the same ones at the
    same places; of equal grams in a window, all are anchors.
    """
    if len(data) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total, inverse = sums or prefix_sums(data)
    hashes = mix((total[k:] - total[:-k]) * inverse[: len(data) - k + 1])
    width = window - k + 1
    least, span = hashes, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(hashes) - width + 1], least[width - span :])
    place = np.flatnonzero(_is_least(hashes, least, width))
    return place, hashes[place]


def _is_least(hashes: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """Whether a gram equals the least value of some window that covers it."""
    # the greatest of the window minima over the windows that cover a gram
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    span = 1
    while span * 2 <= width:
        padded = np.maximum(padded[:-span], padded[span:])
        span *= 2
    if span < width:
        padded = np.maximum(padded[: len(hashes)], padded[width - span : width - span + len(hashes)])
    return hashes == padded[: len(hashes)]
