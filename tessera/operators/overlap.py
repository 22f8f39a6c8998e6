"""Overlapping footprints found where blocks of objects meet; pairs are neither shuffled nor stored.

A pixel that thirty objects share makes 435 pairs, so a join on the pixel moves far more than
the footprints hold. Here each object is one row with its pixels compressed. Objects that lie
near each other make a block; two blocks meet only if their pixels' ranges do, and an object
goes only to blocks that its own range reaches. A pair's shared pixels are all in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators.checkpoints import cut
from tessera.operators.order import numbered, running_total
from tessera.operators.similarity import LEAST_SIMILARITY, OWN_TASKS, _batches, _matrix

#: Pixels of the objects of one block.
BLOCK_PIXELS = 1_000_000
#: Shared pixels that a task looks at together.
TOGETHER = 1_000_000


def _squeeze(x: np.ndarray) -> bytes:
    """Numbers of eight bytes, compressed without loss; first bytes, second bytes ... lie together."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _swell(data: bytes, n: int, kind) -> np.ndarray:
    raw = pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).reshape(-1).view(kind)


def pack(footprint: DataFrame) -> DataFrame:
    """``roi_id, n, low, high, pixels, weights, rest``: an object's pixels in order, in one row; ``rest`` are weights without a pixel.

    A null weight becomes 0; objects without an id are left out.
    """
    w = F.coalesce(F.col("weight").cast("double"), F.lit(0.0))
    entry = F.when(F.col("pixel").isNotNull(), F.struct(F.col("pixel").cast("long").alias("p"), w.alias("w")))
    rest = F.collect_list(F.when(F.col("pixel").isNull(), w)).alias("rest")
    lists = footprint.where("roi_id IS NOT NULL").groupBy(F.col("roi_id").cast("long").alias("roi_id")).agg(F.collect_list(entry).alias("e"), rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["roi_id", "n", "low", "high", "pixels", "weights", "rest"]
        kinds = [pa.int64()] * 4 + [pa.binary()] * 2
        for batch in batches:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy()
            p, w = (lists.values.field(k).to_numpy() for k in (0, 1))
            rows = []
            for roi, a, b in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                order = np.argsort(p[a:b], kind="stable")
                own = p[a:b][order]
                low, high = (int(own[0]), int(own[-1])) if b > a else (0, 0)
                rows.append((roi, b - a, low, high, _squeeze(np.diff(own, prepend=low)), _squeeze(w[a:b][order])))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), batch.column(2)], names)

    return lists.mapInArrow(run, "roi_id long, n long, low long, high long, pixels binary, weights binary, rest array<double>")


def is_packed(footprint: DataFrame) -> bool:
    return "pixels" in footprint.columns


def _entries(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the objects, pixels and weights of all of them."""
    n, low = (table.column(c).to_numpy() for c in ("n", "low"))
    p = [k + np.cumsum(_swell(x, m, np.int64)) for x, m, k in zip(table.column("pixels").to_pylist(), n.tolist(), low.tolist(), strict=True)]
    w = [_swell(x, m, np.float64) for x, m in zip(table.column("weights").to_pylist(), n.tolist(), strict=True)]
    return n, np.concatenate([np.zeros(0, np.int64), *p]), np.concatenate([np.zeros(0), *w])


def unpack(packed: DataFrame) -> DataFrame:
    """``roi_id, pixel, weight`` again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, p, w = _entries(part)
                ids, rest = part.column("roi_id").to_numpy(), part.column("rest")
                yield from _batches([np.repeat(ids, n), p, w], ["roi_id", "pixel", "weight"])
                more = rest.flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, np.diff(rest.offsets.to_numpy()))), pa.nulls(len(more), pa.int64()), pa.array(more)], ["roi_id", "pixel", "weight"])

    return packed.mapInArrow(run, "roi_id long, pixel long, weight double")


def blocks(packed: DataFrame, pixels: int | None = None) -> DataFrame:
    """``roi_id, block``, kept: objects of alike width in the order of their first pixel, about ``pixels`` pixels a block.

    A few wide objects so do not widen the blocks of the others. A small table makes up to
    eight blocks, so that several tasks share it.
    """
    sizes = cut(packed.select("roi_id", "n", "low", F.floor(F.log2(F.col("high") - F.col("low") + 1.0)).alias("width")))
    objects, whole = sizes.agg(F.count("*"), F.sum("n")).first()
    size = max(1, min(pixels or BLOCK_PIXELS, -(-(whole or 0) // min(8, max(1, -(-objects // 100))))))
    total = running_total(numbered(sizes, "width", "low", "roi_id"), "place", "n", "total")
    return cut(total.select("roi_id", F.floor((F.col("total") - F.col("n")) / size).cast("int").alias("block")))


def overlap_edges(packed: DataFrame, objects: DataFrame, names: list[str], power: float = 1.0, pixels: int | None = None) -> DataFrame:
    """``i, j, s_sf, s_<name>..., inter``, directed: ``footprint_similarity`` with the other metrics of its edges.

    ``objects(roi_id, session_id, scored, u_<name>, mu_<name>, sd_<name> ...)``, one row an object:
    unit vectors, and what each first end's cosines are scored against. Edges from an object that is
    not ``scored`` are left out, the other direction stays.
    """
    p = packed.where("n > 0").join(objects.select("roi_id"), "roi_id", "left_semi")
    at = blocks(p, pixels)
    homes = p.join(at, "roi_id")
    ranges = cut(homes.groupBy("block").agg(F.min("low").alias("__low"), F.max("high").alias("__high")).withColumnRenamed("block", "__other"))
    meet = ranges.join(ranges.toDF("__b", "__l", "__h"), (F.col("__low") <= F.col("__h")) & (F.col("__high") >= F.col("__l")) & (F.col("__other") <= F.col("__b"))).count()
    # broadcast: one row for about a million pixels
    dealt = homes.join(objects, "roi_id").join(F.broadcast(ranges), (F.col("low") <= F.col("__high")) & (F.col("high") >= F.col("__low")))
    dealt = dealt.withColumns({"__a": F.least("block", "__other"), "__b": F.greatest("block", "__other")}).drop("__other", "__low", "__high", "high")
    columns = ["i", "j", "s_sf", *(f"s_{k}" for k in names), "inter"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        a, b = table["__a"][0].as_py(), table["__b"][0].as_py()
        home = table["block"].to_numpy()
        left = _side(table.filter(pa.array(home == a)), names, power)
        right = left if a == b else _side(table.filter(pa.array(home == b)), names, power)
        for r, c, s in _shared(left, right, a == b):
            apart = left["session"][r] != right["session"][c]
            s = np.where(s > 1 - 1e-5, 1.0, s)
            found: list[list[np.ndarray]] = [[] for _ in columns]
            cosines = {k: _cosines(left[f"u_{k}"], right[f"u_{k}"], r, c) for k in names}
            for one, p, other, q in ((left, r, right, c), (right, c, left, r)):
                ok = one["scored"][p]
                p, q = p[ok], q[ok]
                scores = [(cosines[k][ok] - one[f"mu_{k}"][p]) / one[f"sd_{k}"][p] for k in names]
                for out, values in zip(found, [one["id"][p], other["id"][q], s[ok], *scores, apart[ok]], strict=True):
                    out.append(values)
            yield from _batches([np.concatenate(x) for x in found], columns)

    kinds = ", ".join(f"`{c}` double" for c in columns[2:-1])
    return dealt.repartition(max(1, min(2 * meet, OWN_TASKS)), "__a", "__b").groupBy("__a", "__b").applyInArrow(run, f"i long, j long, {kinds}, inter boolean")


def _side(table: pa.Table, names: list[str], power: float) -> dict[str, np.ndarray]:
    """A block's objects as arrays; weights as by ``row_normalize``, those that are not above 0 left out."""
    n, p, w = _entries(table)
    w = np.maximum(w, 0.0) ** power
    row = np.repeat(np.arange(len(n)), n)
    rest = table["rest"].combine_chunks()
    other = np.repeat(np.arange(len(n)), np.diff(rest.offsets.to_numpy()))
    whole = (np.bincount(row, w, len(n)) + np.bincount(other, np.maximum(rest.flatten().to_numpy(), 0.0) ** power, len(n)))[row]
    with np.errstate(invalid="ignore"):
        w = np.divide(w, whole, out=np.zeros_like(w), where=whole != 0)
    keep = ~(w <= 0)
    side = {"id": table["roi_id"].to_numpy(), "session": table["session_id"].to_numpy(), "scored": table["scored"].to_numpy(), "row": row[keep], "pixel": p[keep], "weight": w[keep]}
    for k in names:
        side |= {f"u_{k}": _matrix(table[f"u_{k}"].combine_chunks()), f"mu_{k}": table[f"mu_{k}"].to_numpy(), f"sd_{k}": table[f"sd_{k}"].to_numpy()}
    return side


def _cosines(x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of given rows, negatives 0, as ``masked_cosine`` has them."""
    s = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", x[r[at : at + 50_000]], y[c[at : at + 50_000]]) for at in range(0, len(r), 50_000))])
    s = np.maximum(s, 0.0)
    return np.where(~(s <= 1 - 1e-5), 1.0, s)


def _shared(left: dict, right: dict, same: bool, together: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``rows of left, rows of right, sums of the lesser weight over shared pixels``: each pair once, from ``LEAST_SIMILARITY`` on."""
    together = together or TOGETHER
    wide = len(right["id"])
    order = np.argsort(right["pixel"], kind="stable")
    pixel, row, weight = (right[k][order] for k in ("pixel", "row", "weight"))
    to = np.searchsorted(pixel, left["pixel"], "right")
    if same:  # what comes after it among the entries of its pixel
        first = np.empty(len(order), np.int64)
        first[order] = np.arange(1, len(order) + 1)
    else:
        first = np.searchsorted(pixel, left["pixel"], "left")
    met = to - first
    done = np.concatenate([[0], met.cumsum()])
    ends = np.searchsorted(left["row"], np.arange(len(left["id"]) + 1))
    at = 0
    while at < len(left["id"]):
        # objects whose shared pixels are about that many, and one at least
        stop = max(at + 1, int(np.searchsorted(done[ends], done[ends[at]] + together, "right")) - 1)
        stop = min(stop, len(left["id"]))
        n = int(done[ends[stop]] - done[ends[at]])
        cells = (stop - at) * wide
        dense = stop == at + 1 or cells <= max(4 * n, together)
        total = np.zeros(cells) if dense and n else None
        e = ends[at]
        while n and e < ends[stop]:
            f = ends[stop] if not dense else max(e + 1, min(int(np.searchsorted(done, done[e] + together, "right")) - 1, ends[stop]))
            k = met[e:f]
            mine = np.repeat(np.arange(e, f), k)
            theirs = np.arange(len(mine)) - np.repeat(k.cumsum() - k, k) + np.repeat(first[e:f], k)
            cell = (left["row"][mine] - at) * wide + row[theirs]
            least = np.fmin(left["weight"][mine], weight[theirs])
            if dense:
                total += np.bincount(cell, least, cells)
            else:
                found, where = np.unique(cell, return_inverse=True)
                total = np.bincount(where, least, len(found))
            e = f
        if n:
            if dense:
                found = np.flatnonzero(~(total < LEAST_SIMILARITY))
                total = total[found]
            else:
                keep = ~(total < LEAST_SIMILARITY)
                found, total = found[keep], total[keep]
            r, c = found // wide + at, found % wide
            if same:  # pixels that an object has twice
                r, c, total = r[r != c], c[r != c], total[r != c]
            yield r, c, total
        at = stop


def vector_columns(objects: DataFrame, vectors: DataFrame, stats: DataFrame | None, name: str) -> DataFrame:
    """``objects`` with a feature's columns for ``overlap_edges``; those without a vector are left out."""
    out = objects.join(vectors.select("roi_id", S.l2_normalize(F.col("vec")).alias(f"u_{name}")), "roi_id")
    if stats is None:
        return out.withColumns({f"mu_{name}": F.lit(0.0), f"sd_{name}": F.lit(1.0)})
    found = stats.select(F.col("i").alias("roi_id"), F.col("mu").alias(f"mu_{name}"), F.col("sd").alias(f"sd_{name}"), F.lit(True).alias("__had"))
    out = out.join(found, "roi_id", "left").withColumn("scored", F.col("scored") & F.coalesce("__had", F.lit(False)))
    return out.drop("__had").fillna(0.0, [f"mu_{name}"]).fillna(1.0, [f"sd_{name}"])


def one_row_each(roi: DataFrame, features: dict[str, DataFrame]) -> bool:
    """Whether ids are unique, sessions known and vectors whole and of one width, as ``overlap_edges`` takes them."""
    n, ids, known = roi.agg(F.count("*"), F.countDistinct("roi_id"), F.count("session_id")).first()
    if not n == ids == known:
        return False
    for vectors in features.values():
        whole = F.count_if(F.col("roi_id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull()))
        n, ids, good, low, high = vectors.agg(F.count("*"), F.countDistinct("roi_id"), whole, F.min(F.size("vec")), F.max(F.size("vec"))).first()
        if not n == ids == good or low != high:
            return False
    return True
