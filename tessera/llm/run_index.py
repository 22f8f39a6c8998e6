"""Run-length compressed Burrows-Wheeler index of many short texts, with sampled run ends.

The texts are joined with one separator behind each; separators are less than any byte
and ordered by place, so all suffixes differ. Kept are the runs of the transform and, as
samples, the text places of each run's first and last row. (Rows before which a
separator stands are runs of their own, as separators differ from each other.)

Matching statistics come from the samples alone. If a suffix's row does not start a run,
its lexicographic neighbour before it is one place behind the neighbour of the suffix one
place before, and they agree on one symbol less. So the neighbour and the length of the
match change only at sampled places: what holds at a place follows from the last run
start at or before it. A run start's neighbour is the end of the run before, and their
match is measured on the text.
"""

from __future__ import annotations

import numpy as np


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(stable order, whether a row starts a new key)``."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.empty(len(keys), bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return order, new


def _first(new: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(new, rows, 0))


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Places of the suffixes in order; code 0 is a separator, ordered by place.

    Prefix doubling that re-sorts only what is still tied.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    base = int(codes.max()) + 1
    depth = max(1, min(int(62 / np.log2(max(base, 2))), n))
    padded = np.concatenate([codes, np.zeros(depth, np.int64)])
    keys, ended = np.zeros(n, np.int64), np.zeros(n, bool)
    for k in range(depth):
        part = padded[k : n + k]
        keys = keys * base + np.where(ended, 0, part)
        ended |= part == 0
    order, new = _ranks(keys)
    new[ended[order]] = True  # a separator within reach: the stable order by place is final
    rank = np.empty(n, np.int64)
    rank[order] = _first(new, np.arange(n))
    while True:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            return order
        places = order[tied]
        moved, fresh = _ranks(rank[places] * n + rank[places + depth])
        order[tied] = places[moved]
        new[tied] = fresh
        rank[order[tied]] = _first(fresh, tied)
        depth *= 2


class RunIndex:
    """Index of the texts ``data[offsets[t] : offsets[t + 1]]`` (bytes). Text ``t`` starts at place ``first[t]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        count = len(offsets) - 1
        self.first = offsets[:-1] + np.arange(count)
        self.places = n = len(data) + count
        ends = offsets[1:] + np.arange(count)
        inside = np.ones(n, bool)
        inside[ends] = False
        used = np.zeros(256, bool)
        used[data] = True
        codes = np.zeros(n, np.int64)
        codes[inside] = np.cumsum(used)[data]
        order = suffix_array(codes)
        bwt = codes[order - 1]  # before the first place stands, cyclically, the last separator
        start = np.append(True, bwt[1:] != bwt[:-1])[:n] | (bwt == 0)
        self.run_row = np.flatnonzero(start)
        self.run_symbol = bwt[self.run_row]
        self.head_place = order[self.run_row]
        self.tail_place = order[np.append(self.run_row[1:], n) - 1] if n else order
        #: Bytes from each place to its text's end.
        self.left = np.repeat(ends, np.diff(offsets) + 1) - np.arange(n)
        joined = np.zeros(n, np.uint8)
        joined[inside] = data
        before = np.append(-1, self.tail_place[:-1])[: len(self.run_row)]
        length = np.zeros(len(before), np.int64)
        length[1:] = _agree(joined, self.left, self.head_place[1:], before[1:])
        by_place = np.argsort(self.head_place)
        self.sample_place, self.sample_from, self.sample_length = self.head_place[by_place], before[by_place], length[by_place]

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """``(length, source)`` for every place: the longest match of the suffix there with one of lesser order, and where that stands.

        A suffix's best match among all others is this one or that of the suffix whose source it is.
        """
        is_sample = np.zeros(self.places, np.int64)
        is_sample[self.sample_place] = 1
        sample = np.cumsum(is_sample) - 1
        past = np.arange(self.places) - self.sample_place[sample]
        return np.maximum(self.sample_length[sample] - past, 0), self.sample_from[sample] + past


def _agree(joined: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes agree from places ``a`` and ``b`` on, within both texts; eight at a time."""
    padded = np.concatenate([joined, np.zeros(8, np.uint8)])
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view("<u8").ravel()
    most = np.minimum(left[a], left[b])
    length = most.copy()
    alive, k = np.flatnonzero(most > 0), 0
    while len(alive):
        differ = words[a[alive] + k] ^ words[b[alive] + k]
        apart = differ != 0
        lowest = differ[apart] & (~differ[apart] + np.uint64(1))
        length[alive[apart]] = np.minimum(most[alive[apart]], k + np.log2(lowest.astype(float)).astype(np.int64) // 8)
        k += 8
        alive = alive[~apart]
        alive = alive[most[alive] > k]
    return length
