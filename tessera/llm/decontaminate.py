"""Benchmark decontamination by pigeonhole edit matching.

An item of ``n`` normalised characters may differ in ``k = n * ERROR_PERCENT // 100``
edits. Cut into ``k + 1`` pieces, at least one piece of any such occurrence is intact,
so exact piece hits (one automaton over the pieces of all items) find every candidate;
Myers' bit-parallel search then gives the exact least edit distance around the hit.
Documents are only scanned: nothing is shuffled. Items are few next to the corpus; they
are broadcast in blocks of at most ``BLOCK_ITEMS`` items, one scan for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_PERCENT = 6
#: Items below so many normalised characters must occur exactly, between white space.
SHORT_ITEM = 32
BLOCK_ITEMS = 20_000


def normalise(text: str | None) -> str:
    """Lower case, white-space runs as one space, none at the ends."""
    return " ".join((text or "").lower().split())


def pieces(n: int, k: int) -> list[tuple[int, int]]:
    """``k + 1`` pieces of nearly equal length that cover ``range(n)``."""
    return [(i * n // (k + 1), (i + 1) * n // (k + 1)) for i in range(k + 1)]


def myers(item: str, text: str) -> tuple[int, int]:
    """``(least edit distance of the item to a substring of text, end of the first best one)``."""
    n = len(item)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    return _search(peq, n, text)


def _search(peq: dict[str, int], n: int, text: str) -> tuple[int, int]:
    full, high = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score = full, 0, n
    best, end = n, 0
    for i, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = (mv | ~(xh | pv)) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        if score < best:
            best, end = score, i
        ph, mh = ph << 1, mh << 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv
    return best, end


class Matcher:
    """Finds items in normalised texts; ``items`` are ``(item id, text)``."""

    def __init__(self, items: list[tuple[int, str | None]], percent: int = ERROR_PERCENT):
        self.items = []
        at: dict[str, list[tuple[int, int]]] = {}
        for item_id, raw in items:
            text = normalise(raw)
            if not text:
                continue
            k = len(text) * percent // 100 if len(text) >= SHORT_ITEM else 0
            place = len(self.items)
            peq: dict[str, int] = {}
            for i, c in enumerate(text):
                peq[c] = peq.get(c, 0) | 1 << i
            self.items.append((item_id, text, k, peq))
            for a, b in pieces(len(text), k):
                at.setdefault(text[a:b], []).append((place, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        if at:
            self.automaton.make_automaton()
        self.ready = bool(at)

    def find(self, raw: str | None) -> list[tuple[int, int, int]]:
        """``(item id, distance, end in the normalised text)`` of the best occurrence of each item that is within its budget."""
        text = normalise(raw)
        if not text or not self.ready:
            return []
        starts: dict[int, set[int]] = {}
        for last, (length, places) in self.automaton.iter(text):
            for place, a in places:
                starts.setdefault(place, set()).add(last + 1 - length - a)
        found = []
        for place, guesses in starts.items():
            item_id, item, k, peq = self.items[place]
            best = None
            for low, high in _spans(sorted(guesses), k):
                left = max(0, low - k)
                if k:
                    distance, end = _search(peq, len(item), text[left : high + len(item) + k])
                else:
                    distance, end = self._whole(text, item, low, high)
                if distance <= k and (best is None or (distance, left + end) < best):
                    best = distance, left + end
            if best:
                found.append((item_id, *best))
        return sorted(found, key=lambda x: (_by_id(x), *x[1:]))

    @staticmethod
    def _whole(text: str, item: str, low: int, high: int) -> tuple[int, int]:
        for s in range(max(0, low), high + 1):
            e = s + len(item)
            if text.startswith(item, s) and (len(item) >= SHORT_ITEM or ((s == 0 or text[s - 1] == " ") and (e == len(text) or text[e] == " "))):
                return 0, e - max(0, low)
        return 1, 0


def _by_id(row: tuple) -> tuple[bool, int]:
    """Order by the id in front, nulls first."""
    return row[0] is not None, row[0] or 0


def _spans(sorted_starts: list[int], k: int) -> Iterator[tuple[int, int]]:
    """Runs of guesses that lie within 2k + 1 of each other."""
    low = high = sorted_starts[0]
    for s in sorted_starts[1:]:
        if s - high > 2 * k + 1:
            yield low, high
            low = s
        high = s
    yield low, high


def _matchers(items: DataFrame, item_id: str, item_text: str, percent: int) -> Iterator:
    """Broadcast lists of at most about BLOCK_ITEMS items."""
    spark = items.sparkSession
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text IS NOT NULL")
    blocks = -(-rows.count() // BLOCK_ITEMS)
    for block in range(blocks):
        mine = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield spark.sparkContext.broadcast((sorted(map(tuple, mine.collect()), key=lambda x: (_by_id(x), x[1])), percent))


_built: dict = {}


def _matcher(shared) -> Matcher:
    """One automaton per worker and broadcast."""
    if shared.value[0] and id(shared.value) not in _built:
        _built.clear()
        _built[id(shared.value)] = (shared.value, Matcher(*shared.value))
    return _built[id(shared.value)][1] if shared.value[0] else Matcher([])


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", percent: int = ERROR_PERCENT) -> DataFrame:
    """``doc_id, item_id, distance, match_end``: each item within its budget of some part of each document.

    ``match_end`` counts characters of the normalised document. Defined cases: null or
    empty texts and items match nothing; items of fewer than ``SHORT_ITEM`` characters
    must occur exactly and between white space; repeated documents and items give
    repeated rows; null document and item ids are reported as null; empty tables give no rows;
    other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, distance int, match_end int"
    out = None
    for shared in _matchers(items, item_id, item_text, percent):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared)
            for batch in batches:
                rows = [(i.as_py(), *f) for i, t in zip(batch.column(0), batch.column(1), strict=True) for f in matcher.find(t.as_py())]
                columns = zip(*rows, strict=True) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "item_id", "distance", "match_end"])

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else texts.limit(0).selectExpr("doc_id", "0L AS item_id", "0 AS distance", "0 AS match_end")


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", percent: int = ERROR_PERCENT) -> DataFrame:
    """The rows of ``docs`` that hold no item; same columns. Nothing is shuffled."""
    kept = docs
    place = docs.columns.index(text_col)
    for shared in _matchers(items, item_id, item_text, percent):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(t.as_py()) for t in batch.column(place)], pa.bool_()))

        kept = kept.mapInArrow(run, kept.schema)
    return kept
