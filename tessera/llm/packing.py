"""Variable-capacity best-fit packing of documents into training sequences.

Pieces are dealt by a hash into shards of about ``SHARD_PIECES`` pieces, as many shards
as the input needs, so no task grows with the table. In a shard, pieces come longest
first. A piece goes to the open bin that it fills best. If none has room, a bin is
opened, of the permitted capacity that costs least for each token it will hold: for every
capacity that takes the piece, the bin is filled on trial with the longest remaining
pieces that fit, and the cost of what it would shrink to is divided by its contents.
At the end every bin is downsized to the least capacity that holds its contents. The
capacities are thus chosen jointly, bin by bin, against all that remains to be placed;
packings that open one size only are tried too, and the least total cost is kept.

The cost of a sequence is its length, a fixed ``OVERHEAD`` and an attention term that
grows with the square of the length (``ATTENTION``), all in tokens.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import Workspace

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a sequence besides its capacity, in tokens.
OVERHEAD = 16
#: A sequence of this many tokens costs as much again for attention.
ATTENTION = 16_384
SHARD_PIECES = 8192
#: Equal rows that one row is unrolled to at once.
UNROLLED = 4096

BINS = "bin_id long, capacity int, used int, doc_ids array<long>, starts array<long>, lengths array<int>"


def word_count(text: Column) -> Column:
    """Words of a whole text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def sequence_cost(capacity: int, overhead: int = OVERHEAD, attention: int | None = ATTENTION) -> float:
    """What a sequence of this capacity costs, in tokens."""
    return overhead + capacity + (capacity * capacity / attention if attention else 0.0)


class _Remaining:
    """Lengths that are still to be placed, as counts and a bit set."""

    def __init__(self, lengths: Sequence[int]):
        self.count: dict[int, int] = {}
        for n in lengths:
            self.count[n] = self.count.get(n, 0) + 1
        self.bits = sum(1 << n for n in self.count)

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.bits ^= 1 << n

    def fill(self, room: int) -> int:
        """Tokens that the longest pieces that fit, one after another, would put into ``room``."""
        bits, used = self.bits & ~1, 0
        while room > 0:
            below = bits & ((2 << room) - 1)
            if not below:
                break
            n = below.bit_length() - 1
            many = min(self.count[n], room // n)
            used, room = used + many * n, room - many * n
            bits = below & ~(1 << n)
        return used


def best_fit(lengths: Sequence[int], capacities: Sequence[int], costs: dict[int, float], open_size: int | None = None) -> tuple[list[int], list[int]]:
    """``(bin of each piece, contents of each bin)`` for pieces in the given order.

    With ``open_size``, all bins are opened at that size (or the least that holds the
    piece); without it, each at the capacity of least cost a token.
    """
    rooms: list[list[int]] = [[] for _ in range(capacities[-1] + 1)]
    mask = 0  # bit r: some bin has r tokens of room
    rest = _Remaining(lengths) if open_size is None else None
    where, used, size = [], [], []

    def least_cost(n: int) -> int:
        best = None
        for c in capacities:
            if c >= n:
                held = n + rest.fill(c - n)
                shrunk = next(x for x in capacities if x >= held)
                rate = costs[shrunk] / max(held, 1)
                if best is None or rate <= best[0]:
                    best = rate, c
        return best[1]

    for n in lengths:
        if rest is not None:
            rest.take(n)
        above = mask >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            bin_ = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            bin_ = len(used)
            used.append(0)
            size.append(least_cost(n) if rest is not None else open_size if n <= open_size else next(c for c in capacities if c >= n))
        used[bin_] += n
        room = size[bin_] - used[bin_]
        if not rooms[room]:
            mask |= 1 << room
        rooms[room].append(bin_)
        where.append(bin_)
    return where, used


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, attention: int | None = ATTENTION) -> tuple[list[int], list[int], list[int]]:
    """``(bin of each piece, contents, final capacity of each bin)``, of least total cost among the ways to open bins.

    Ties go to bins of jointly chosen sizes, then to the smaller single size; of open bins
    with equal room, to the one that came to it last.
    """
    costs = {c: sequence_cost(c, overhead, attention) for c in capacities}
    best = None
    for open_size in (None, *capacities):
        where, used = best_fit(lengths, capacities, costs, open_size)
        final = [next(c for c in capacities if c >= u) for u in used]
        cost = sum(costs[c] for c in final)
        if best is None or cost < best[0]:
            best = cost, where, used, final
    return best[1:]


def pack_documents(docs: DataFrame, id_col: str = "doc_id", length: Column | None = None, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, text_col: str = "text", attention: int | None = ATTENTION) -> DataFrame:
    """One row per bin: ``bin_id, capacity, used, doc_ids, starts, lengths``.

    The last three are parallel: piece ``i`` of a bin is ``lengths[i]`` tokens of document
    ``doc_ids[i]`` from token ``starts[i]``. ``length`` is a column of token counts;
    without it, words of ``text_col``. A document longer than the largest capacity is cut
    into pieces of that capacity and a rest; every token of every document is in exactly
    one bin. A null or negative length counts as 0; a document of length 0 is a piece of
    length 0. Repeated ids and null ids are packed like others; rows of equal id and
    length are numbered and dealt by that number too, so that none of it depends on the
    files' layout. Pieces of equal length are taken by id, start and number, null ids
    last. An empty table gives no bins; other columns are ignored.
    """
    capacities = tuple(sorted(set(capacities)))
    most = capacities[-1]
    space = Workspace(docs.sparkSession, "packing")
    n = F.greatest(F.coalesce((word_count(F.col(text_col)) if length is None else length).cast("long"), F.lit(0)), F.lit(0))
    # equal rows are counted before they are shuffled, and unrolled in two steps after it
    sizes = space.put("sizes", docs.select(F.col(id_col).cast("long").alias("id"), n.alias("n")).groupBy("id", "n").agg(F.count("*").alias("rows")))
    total = sizes.select(F.sum(F.col("rows") * F.greatest(F.ceil(F.col("n") / most), F.lit(1)))).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_PIECES))
    up_to = lambda last: F.sequence(F.lit(0).cast("long"), last.cast("long"))
    runs = sizes.select("id", "n", "rows", F.explode(up_to(F.floor((F.col("rows") - 1) / UNROLLED))).alias("run"))
    if sizes.where(F.col("rows") > UNROLLED).isEmpty():
        each = runs
    else:
        each = runs.repartition("id", "n", "run")
    each = each.select("id", "n", F.explode(F.sequence(F.col("run") * UNROLLED, F.least(F.col("rows"), (F.col("run") + 1) * UNROLLED) - 1)).alias("copy"))
    pieces = each.select("id", "n", "copy", F.explode(up_to(F.greatest(F.floor((F.col("n") - 1) / most), F.lit(0)))).alias("part"))
    pieces = pieces.select("id", "copy", (F.col("part") * most).alias("start"), F.least(F.col("n") - F.col("part") * most, F.lit(most)).cast("int").alias("n"))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "start", "copy"), F.lit(shards)))

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        ids = table["id"].to_numpy()
        ids, absent = np.where(np.isnan(ids), -1, ids).astype(np.int64) if ids.dtype.kind == "f" else ids, table["id"].is_null().to_numpy()
        start, size = table["start"].to_numpy(), table["n"].to_numpy()
        order = np.lexsort((table["copy"].to_numpy(), start, ids, absent, -size))
        where, used, final = pack(size[order].tolist(), capacities, overhead, attention)
        where = np.array(where)
        by_bin = np.argsort(where, kind="stable")
        taken = order[by_bin]
        at = pa.array(np.searchsorted(where[by_bin], np.arange(len(used) + 1)).astype(np.int32))
        parts = pa.array(ids[taken], mask=absent[taken]), pa.array(start[taken]), pa.array(size[taken].astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array((key[0].as_py() << 32) + np.arange(len(used))), pa.array(final, pa.int32()), pa.array(used, pa.int32()), *(pa.ListArray.from_arrays(at, p) for p in parts)],
            ["bin_id", "capacity", "used", "doc_ids", "starts", "lengths"],
        )

    return dealt.groupBy("shard").applyInArrow(run, BINS)
