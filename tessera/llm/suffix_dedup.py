"""Exact removal of repeated byte runs through run-length compressed indexes.

A byte goes if some ``window`` bytes that cover it also start earlier in the corpus
(smaller document, or same document and earlier start). One index of the whole corpus
would not be distributed, so equal windows are first brought together:

1. Exact copies of a document are found by digest; a copy repeats its original in whole.
2. *Anchors.* In each window, the ``GRAM`` bytes of least hash are its anchor; equal
   windows have equal anchors at equal places. An anchor's context, the union of the
   windows that can have it, is ``2 * window - GRAM`` bytes long.
3. Anchors are sorted by hash, digest of the context and place, one shuffle of numbers.
   An anchor whose context stood before repeats in whole; no bytes are needed. An anchor
   that is alone, or whose contexts are all equal, is done.
4. *Index.* The contexts that share an anchor but differ go to one task, which builds a
   run-length Burrows-Wheeler index with sampled run ends (``RunIndex``) of some thousand
   contexts and streams the matching statistics of all of them. Places whose match is
   ``window`` bytes long or more are chained to their sources; every window that is not
   the earliest of its chain is marked.
5. Marks are merged per document.

An anchor with more than ``HOT`` different contexts is split: its windows are dealt by
where the anchor stands in them into ``SPLIT`` families, each under the digest of all
bytes its windows share, so that only contexts which agree on most of a window meet.
A family with more than ``DIRECT`` contexts is dealt to several indexes; each marks within
its own contexts, and sends on the digests of the windows that are earliest in it, of
which all but the earliest of all indexes are marked too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.anchors import anchors, digests, prefix_sums
from tessera.llm.run_index import RunIndex
from tessera.llm.shingles import mix, text_chunks
from tessera.llm.store import Workspace, few

WINDOW = 100
GRAM = 40
HOT = 2000
SPLIT = 4
#: Contexts of one family that one index holds at most.
DIRECT = 8000
#: Contexts that one index holds, if no anchor has more.
BLOCK = 2500
#: Anchors among which equal contexts are thinned out before the shuffle.
COMBINED = 1 << 20
#: Documents with marks (or copies) that may be broadcast; beyond it, a shuffle join.
BROADCAST_DOCS = 300_000

_FAR = (1 << 31) - 1


def _anchor_rows(window: int, gram: int):
    """(doc, text) -> (key, anchor, context, doc, place, again).

    Of equal contexts within a batch only the earliest goes to its anchor (``key`` is the
    anchor); the others are known to stand earlier and travel under a key of their document,
    so that text which very many documents share is thinned out before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found: list[tuple[np.ndarray, ...]] = []
            for row, data, offsets in text_chunks(batch.column(1)):
                for k in range(len(offsets) - 1):
                    text = data[offsets[k] : offsets[k + 1]]
                    sums = prefix_sums(text)
                    at, hashes = anchors(text, window, gram, sums)
                    if len(at):
                        left, right = np.maximum(at - (window - gram), 0), np.minimum(at + window, len(text))
                        # how far an end of the document cuts a context short is part of its digest
                        contexts = mix(digests(*sums, left, right) + (at - left).astype(np.uint64))
                        found.append((hashes, contexts, np.full(len(at), ids[row + k]), at))
                if sum(len(x[0]) for x in found) > COMBINED:
                    yield _thinned(found)
                    found = []
            if found:
                yield _thinned(found)

    return run


def _thinned(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    anchor, context, doc, place = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((place, doc))
    both = mix(anchor + mix(context))[order]
    sort = np.argsort(both, kind="stable")
    again = np.zeros(len(both), bool)
    again[order[sort[1:]]] = both[sort[1:]] == both[sort[:-1]]
    key = np.where(again, mix(doc.astype(np.uint64) * np.uint64(4096) + (place >> 9).astype(np.uint64)), anchor)
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), pa.array(doc), pa.array(place.astype(np.int32)), pa.array(again)], ["key", "anchor", "context", "doc", "place", "again"]
    )


def _sifter(most: int):
    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (anchor, context, doc, place, again), sorted -> (kind, anchor, doc, place).

        Kind 0: the context stood before. Kind 1: the first of one of several contexts of the
        anchor. Kind 2 (no doc): the anchor has more than ``most`` contexts. Memory is one batch.
        """
        before = None  # the last row's anchor and context
        head, alone, contexts = None, False, 0  # the current anchor's first row, whether it is yet to be sent, contexts so far

        def rows(kind, anchor, doc, place):
            n = len(anchor)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(anchor), pa.array(doc) if kind < 2 else pa.nulls(n, pa.int64()), pa.array(np.asarray(place, np.int32))], ["kind", "anchor", "doc", "place"])

        for batch in batches:
            anchor, context, doc, place = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
            known = batch.column(4).to_numpy(zero_copy_only=False).astype(bool)
            if known.any():
                yield rows(0, anchor[known], doc[known], place[known])
                anchor, context, doc, place = (x[~known] for x in (anchor, context, doc, place))
            if not len(anchor):
                continue
            again = np.zeros(len(anchor), bool)
            again[1:] = (anchor[1:] == anchor[:-1]) & (context[1:] == context[:-1])
            again[0] = before is not None and before == (anchor[0], context[0])
            before = (anchor[-1], context[-1])
            if again.any():
                yield rows(0, anchor[again], doc[again], place[again])
            anchor, doc, place = anchor[~again], doc[~again], place[~again]
            if not len(anchor):
                continue
            carried = head is not None and head[0] == anchor[0]
            if head is not None and not carried and contexts > most:
                yield rows(2, np.array([head[0]]), np.zeros(1, np.int64), [0])
            if carried:
                anchor, doc, place = (np.append(h, x) for h, x in zip(head, (anchor, doc, place), strict=True))
            start = np.append(True, anchor[1:] != anchor[:-1])
            end = np.append(start[1:], True)
            keep = ~(start & end)
            if carried and not alone:
                keep[0] = False
            firsts = np.flatnonzero(start)
            sizes = np.diff(np.append(firsts, len(anchor)))
            total = sizes.copy()
            if carried:
                total[0] += contexts - 1
            hot = firsts[:-1][total[:-1] > most]
            if len(hot):
                yield rows(2, anchor[hot], np.zeros(len(hot), np.int64), np.zeros(len(hot)))
            if keep.any():
                yield rows(1, anchor[keep], doc[keep], place[keep])
            last = firsts[-1]
            same_head = carried and last == 0
            alone = bool(sizes[-1] == 1) and not (same_head and not alone)
            contexts = int(total[-1])
            head = (anchor[last], doc[last], place[last])
        if head is not None and contexts > most:
            yield rows(2, np.array([head[0]]), np.zeros(1, np.int64), [0])

    return sift


def _cut(window: int, gram: int):
    """(doc, text, anchors) -> (key, hot, doc, start, bytes): the contexts to index; those of hot anchors in families."""
    reach = window - gram
    edges = [reach * k // SPLIT for k in range(SPLIT)] + [reach + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for k, (text, found) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                whole = (text.as_py() or "").encode()
                keys, hot, starts, parts = [], [], [], []
                for a in found.as_py():
                    p = a["place"]
                    if not a["hot"]:
                        left = max(0, p - reach)
                        keys.append(a["anchor"])
                        hot.append(False)
                        starts.append(left)
                        parts.append(whole[left : p + window])
                        continue
                    for low, high in zip(edges[:-1], edges[1:], strict=True):
                        # windows with low .. high - 1 bytes before the anchor all hold these bytes
                        shared = whole[p - low : p + window - (high - 1)] if p >= low else b""
                        left, right = max(0, p - (high - 1)), min(len(whole), p + window - low)
                        if right - left >= window and len(shared) == window - (high - 1 - low):
                            keys.append(int.from_bytes(hashlib.blake2b(shared, digest_size=8, salt=bytes([low])).digest(), "big", signed=True))
                            hot.append(True)
                            starts.append(left)
                            parts.append(whole[left:right])
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hot, pa.bool_()), pa.array(np.full(len(keys), ids[k])), pa.array(starts, pa.int32()), pa.array(parts, pa.binary())], ["key", "hot", "doc", "start", "bytes"])

    return run


def _marks(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest: np.ndarray | None = None) -> pa.RecordBatch:
    """Spans to remove, or (with ``digest``) windows that are earliest in their index."""
    none = pa.nulls(len(docs), pa.int64())
    return pa.RecordBatch.from_arrays([none if digest is None else pa.array(digest.view(np.int64)), pa.array(docs), pa.array(starts.astype(np.int32)), pa.array(ends.astype(np.int32))], ["digest", "doc", "start", "end"])


def _columns(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(docs, starts, all bytes, offsets)``."""
    column = rows["bytes"].combine_chunks().cast(pa.large_binary())
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return rows["doc"].to_numpy(), rows["start"].to_numpy().astype(np.int64), data, offsets - offsets[0]


def earliest_of_chain(source: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Least value in each place's chain; ``source`` leads towards the chain's head, which leads to itself."""
    head = source
    while not np.array_equal(head, further := head[head]):
        head = further
    least = np.full(len(value), np.iinfo(np.int64).max)
    np.minimum.at(least, head, value)
    return least[head]


def _by_index(rows: pa.Table, window: int, split: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Spans of the windows in ``rows`` that stand earlier in ``rows`` too, through one index; of ``split`` rows, also the windows that do not."""
    docs, starts, data, offsets = _columns(rows)
    index = RunIndex(data, offsets)
    length, source = index.matching_statistics()
    text = np.repeat(np.arange(len(docs)), np.diff(offsets) + 1)
    place = starts[text] + np.arange(index.places) - index.first[text]
    rank = np.unique(docs, return_inverse=True)[1]
    value = (rank[text] << 32) + place
    earliest = earliest_of_chain(np.where(length >= window, source, np.arange(index.places)), value)
    whole = index.left >= window
    marked = whole & (value > earliest)
    # runs of marked windows within a context; the separators between contexts are never marked
    first, last = marked.copy(), marked.copy()
    first[1:] &= ~marked[:-1]
    last[:-1] &= ~marked[1:]
    yield _marks(docs[text[first]], place[first], place[last] + window)
    if split.any():
        new = np.flatnonzero(whole & ~marked & split[text])
        left = new - text[new]
        yield _marks(docs[text[new]], place[new], place[new] + window, digests(*prefix_sums(data), left, left + window))


def _matcher(window: int, direct: int, block: int):
    """Rows (key, split, doc, start, bytes), sorted -> (digest, doc, start, end): spans to remove, and earliest windows of split keys.

    A key with more than ``direct`` rows is indexed in parts, as if it had been split.
    Memory is one index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, parted = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]) if rest is not None else rows
            key = rows["key"].to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            yield from whole(rows.slice(0, last), parted)
            rest = rows.slice(last)
            if key[-1] != parted:
                parted = None
            while rest.num_rows > direct:
                parted = key[-1]
                yield from _by_index(rest.slice(0, direct), window, np.ones(direct, bool))
                rest = rest.slice(direct)
        if rest is not None:
            yield from whole(rest, parted)

    def whole(rows: pa.Table, parted: int | None) -> Iterator[pa.RecordBatch]:
        """All rows of these keys are here, but for those of ``parted`` that an index has had."""
        if not rows.num_rows:
            return
        key, split = rows["key"].to_numpy(), rows["split"].to_numpy()
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(start, len(key)))
        for k in np.flatnonzero(sizes > direct):
            for at in range(0, sizes[k], direct):
                n = min(direct, sizes[k] - at)
                yield from _by_index(rows.slice(start[k] + at, n), window, np.ones(n, bool))
        split = split | (key == parted) if parted is not None else split
        fit = (sizes <= direct) & ((sizes > 1) | split[start])
        start, sizes = start[fit], sizes[fit]
        group = (np.cumsum(sizes) - 1) // block
        for g in np.unique(group):
            mine = group == g
            at = np.repeat(start[mine], sizes[mine]) + np.arange(sizes[mine].sum()) - np.repeat(np.cumsum(sizes[mine]) - sizes[mine], sizes[mine])
            yield from _by_index(rows.take(pa.array(at)), window, split[at])

    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, doc, start, end), sorted -> the spans of all but the earliest place of each digest. Memory is one batch."""
    seen, head = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        digest, doc, start, end = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        new = np.append(seen is None or digest[0] != seen, digest[1:] != digest[:-1])
        at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        carried = head or (0, 0)
        first_doc, first_start = np.where(at < 0, carried[0], doc[at]), np.where(at < 0, carried[1], start[at])
        again = (doc != first_doc) | (start != first_start)
        seen, head = digest[-1], (first_doc[-1], first_start[-1])
        yield pa.RecordBatch.from_arrays([pa.array(doc[again]), pa.array(start[again]), pa.array(end[again])], ["doc", "start", "end"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, list of (start, end)) -> (doc, merged spans as 32-bit pairs)."""
    for batch in batches:
        merged = []
        for spans in batch.column(1):
            flat = spans.values.flatten()
            start, end = (np.asarray(x.to_numpy(zero_copy_only=False), np.int64) for x in flat)
            order = np.argsort(start, kind="stable")
            start, end = start[order], np.maximum.accumulate(end[order])
            new = np.append(True, start[1:] > end[:-1])
            merged.append(np.stack([start[new], end[np.append(new[1:], True)]], 1).astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(merged, pa.binary())], ["doc", "spans"])


def _apply(window: int):
    """(doc_id, text, spans) -> the result row, from the whole text and its spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                whole = (text.as_py() or "").encode()
                pairs = np.frombuffer(spans.as_py(), "<i4").reshape(-1, 2) if spans.is_valid and len(whole) >= window else np.zeros((0, 2), np.int32)
                kept, at, removed = [], 0, 0
                for start, end in pairs.tolist():
                    end = min(end, len(whole))
                    kept.append(whole[at:start])
                    removed += end - start
                    at = end
                kept.append(whole[at:])
                rows.append((len(whole), removed, len(pairs), hashlib.sha256(b"".join(kept)).hexdigest(), [{"start": int(s), "end": min(int(e), len(whole))} for s, e in pairs]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot_contexts: int = HOT, direct: int = DIRECT, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` (bytes, end exclusive).

    Defined cases: a null text is empty; a text of fewer than ``window`` bytes loses
    nothing; rows that repeat an id are documents of their own, ordered by id and then
    text; a null id comes before all others; an empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "suffix-dedup")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def heads_of(rows: DataFrame) -> DataFrame:
        return rows.select("doc", F.octet_length(F.coalesce("text", F.lit(""))).alias("n"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))

    keyed = rows.withColumn("doc", F.col("doc_id"))
    heads = space.put("heads", heads_of(keyed))
    if not heads.groupBy("doc").count().where("count > 1 OR doc IS NULL").isEmpty():
        keyed = space.put("keyed", rows.orderBy(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text")).withColumn("doc", F.monotonically_increasing_id()))
        heads = space.put("keyed-heads", heads_of(keyed))

    long = heads.where(F.col("n") >= window)
    firsts = space.put("firsts", long.groupBy("digest").agg(F.min("doc").alias("first"), F.count("*").alias("copies")).where("copies > 1"))
    copies = space.put("copies", long.join(firsts, "digest").where("doc <> first").select("doc"))
    gone = F.broadcast(copies) if few(copies, BROADCAST_DOCS) else copies
    texts = keyed.where(F.octet_length("text") >= window).join(gone, "doc", "left_anti").select("doc", "text")

    found = texts.mapInArrow(_anchor_rows(window, gram), "key long, anchor long, context long, doc long, place int, again boolean")
    sorted_rows = found.repartition(F.col("key")).drop("key").sortWithinPartitions("anchor", "context", "doc", "place")
    sifted = space.put("sifted", sorted_rows.mapInArrow(_sifter(hot_contexts), "kind int, anchor long, doc long, place int"))

    hot = sifted.where("kind = 2").select("anchor").distinct().withColumn("hot", F.lit(True))
    if few(hot, BROADCAST_DOCS):
        hot = F.broadcast(hot)
    wanted = sifted.where("kind = 1").join(hot, "anchor", "left")
    wanted = wanted.groupBy("doc").agg(F.collect_list(F.struct("anchor", "place", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("anchors"))
    cut = texts.join(wanted, "doc").select("doc", "text", "anchors").mapInArrow(_cut(window, gram), "key long, hot boolean, doc long, start int, bytes binary")
    cut = space.put("contexts", cut)
    # a family too large for one index is dealt to several
    large = space.put("large", cut.where("hot").groupBy("key").agg(F.ceil(F.count("*") / direct).alias("indexes")).where("indexes > 1"))
    cut = cut.join(F.broadcast(large) if few(large, BROADCAST_DOCS) else large, "key", "left")
    key = F.when(F.col("indexes").isNotNull(), F.xxhash64("key", F.pmod(F.xxhash64("doc", "start"), F.col("indexes")))).otherwise(F.col("key"))
    cut = cut.select(key.alias("key"), F.col("indexes").isNotNull().alias("split"), "doc", "start", "bytes")
    together = cut.repartition(F.col("key")).sortWithinPartitions("key", "doc", "start")
    marks = space.put("marks", together.mapInArrow(_matcher(window, direct, block), "digest long, doc long, start int, end int"))
    space.drop("contexts")
    dealt = marks.where("digest IS NOT NULL")
    marks = marks.where("digest IS NULL").drop("digest")
    if not dealt.isEmpty():
        marks = marks.unionByName(dealt.repartition(F.col("digest")).sortWithinPartitions("digest", "doc", "start").mapInArrow(_later, "doc long, start int, end int"))

    again = sifted.where("kind = 0").select("doc", F.greatest(F.col("place") - (window - gram), F.lit(0)).alias("start"), (F.col("place") + window).alias("end"))
    copied = copies.select("doc", F.lit(0).alias("start"), F.lit(_FAR).alias("end"))
    every = marks.unionByName(again).unionByName(copied)
    spans = space.put("spans", every.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans")).mapInArrow(_merge, "doc long, spans binary"))
    space.drop("sifted")
    space.drop("marks")
    if few(spans, BROADCAST_DOCS, F.octet_length("spans") + 48):
        spans = F.broadcast(spans)
    whole = keyed.join(spans, "doc", "left").select("doc_id", "text", "spans")
    return whole.mapInArrow(_apply(window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>")
