from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm.anchors import anchors
from tessera.llm.run_index import RunIndex
from tessera.llm.suffix_dedup import repeated_spans

from .common import with_clashes


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)


@pytest.mark.parametrize("seed", range(12))
def test_matching_statistics_come_from_the_run_ends(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab" if seed % 2 else "abcdefg") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 12))]
    if seed % 3 == 0:
        texts = [texts[0] + t for t in texts] + texts
    data, offsets = packed(texts)
    index = RunIndex(data, offsets)
    length, source = index.matching_statistics()
    suffixes = [(texts[t][p:], t, p) for t in range(len(texts)) for p in range(len(texts[t]))]
    ordered = sorted(((*map(ord, x), -1, t), t, p) for x, t, p in suffixes)  # a separator is less than any byte, and the earlier the less
    place = lambda t, p: int(index.first[t]) + p
    best = {}
    for (_, t, p), (_, u, q) in zip(ordered[1:], ordered, strict=False):
        a, b = texts[t][p:], texts[u][q:]
        match = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert length[place(t, p)] == match and (not match or source[place(t, p)] == place(u, q))
        best[place(t, p)] = match
    assert len(index.sample_place) == len(index.run_row) <= index.places
    # the longest match anywhere else is one of the two neighbours'
    after = np.zeros(index.places, np.int64)
    np.maximum.at(after, source[length > 0], length[length > 0])
    for x, t, p in suffixes[:: max(1, len(suffixes) // 20)]:
        longest = max((k for k in range(len(x) + 1) if sum(texts[u].startswith(x[:k], q) for u in range(len(texts)) for q in range(len(texts[u]) - k + 1)) > 1), default=0)
        assert max(length[place(t, p)], after[place(t, p)]) == longest


def test_repetitive_texts_have_few_runs():
    rng = random.Random(1)
    base = "".join(rng.choice("acgt") for _ in range(150))
    data, offsets = packed([base[:k] + "x" + base[k:] for k in range(100)])
    index = RunIndex(data, offsets)
    assert len(index.run_row) < 0.1 * index.places


def test_the_operator_marks_by_the_statistics(spark, monkeypatch):
    """Without the sampled run ends' matches, nothing that only an index can find is marked."""
    from tessera.llm import suffix_dedup

    rng = random.Random(2)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(120))
    rows = [(k, "".join(rng.choice("abcdefgh ") for _ in range(89)) + str(k) + shared + str(k) + "".join(rng.choice("abcdefgh ") for _ in range(90))) for k in range(6)]
    data, offsets = packed([t for _, t in rows])
    table = pa.table({"key": [1] * 6, "split": [False] * 6, "doc": list(range(6)), "start": pa.array([0] * 6, pa.int32()), "bytes": pa.array([t.encode() for _, t in rows], pa.binary())})
    found = pa.Table.from_batches(suffix_dedup._by_index(table, 100, np.zeros(6, bool)))
    assert found["doc"].to_pylist() == [1, 2, 3, 4, 5] and set(found["start"].to_pylist()) == {90} and set(found["end"].to_pylist()) == {210}
    monkeypatch.setattr(RunIndex, "matching_statistics", lambda self: (np.zeros(self.places, np.int64), np.arange(self.places)))
    assert pa.Table.from_batches(suffix_dedup._by_index(table, 100, np.zeros(6, bool))).num_rows == 0


def test_equal_windows_have_equal_anchors():
    rng = random.Random(1)
    shared = bytes(rng.choice(b"abc ") for _ in range(60))
    for _ in range(50):
        a, b = (bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, 40))) for _ in range(2))
        places = [{p - len(x) for p in anchors(np.frombuffer(x + shared + y, np.uint8), 30, 9)[0] if len(x) <= p <= len(x) + 60 - 9} for x, y in ((a, b), (b, a))]
        for start in range(31):
            inside = [{p for p in ps if start <= p <= start + 21} for ps in places]
            assert inside[0] and inside[0] & inside[1]


def brute(rows, window):
    first, out = {}, {}
    for d, t in rows:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for i in range(len(b) - window + 1):
            w = b[i : i + window]
            if w in first:
                mark[i : i + window] = b"\1" * window
            else:
                first[w] = i
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        out[d] = (len(b), sum(mark), sum(1 for i in range(len(mark)) if mark[i] and not (i and mark[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(40), text(8)
    rows = [(k, (text(rng.randint(1, 60)) + (" " + passage[rng.randint(0, 40) :] if k % 3 == 0 else "") + (" " + line) * (k % 2))) for k in range(60)]
    base = text(80)
    rows += [(60 + k, base[: rng.randint(0, 300)] + rng.choice("xyé") + base[rng.randint(0, 300) :]) for k in range(25)]
    rows += [(90, base), (91, base), (92, "na " * 200), (93, "na " * 150 + "end"), (94, None), (95, ""), (96, "é" * 120), (97, "x" * 99), (98, "x" * 99), (99, "x" * 100), (100, text(4000) + passage)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"hot_contexts": 2, "direct": 4, "block": 10}, {"hot_contexts": 10**6, "direct": 4, "block": 7}, {"hot_contexts": 2, "direct": 1, "block": 1}])
def test_removal_equals_brute_force(spark, sizes):
    rows = corpus(3)
    got = repeated_spans(with_clashes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), **sizes)
    want = brute(rows, 100)
    for r in got.collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
    assert got.count() == len(rows)


def test_repeated_ids_nulls_and_empty_tables(spark):
    text = "abcdefghij" * 12
    long = "".join(chr(97 + (k * k) % 26) for k in range(150))
    rows = [(1, long), (1, long), (2, None), (None, long), (3, "q"), (3, text)]
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    own = brute([(0, text)], 100)[0][1]
    head = brute([(0, long)], 100)[0][1]
    assert got == sorted([(0, head), (1, 150), (1, 150), (2, 0), (3, 0), (3, own)])
    assert repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
