"""Exact top-k inner products over norm-sorted, SVD-rotated vectors.

Vectors are integers (``floor(1024 * x)``), so scores are exact. The Gram matrix of all
vectors, scaled to length one, gives an orthogonal basis in which the first coordinates
carry most of the length.

All rows are put in *ranges* by descending length, and in order within each. The longest
rows (``SEEDS``, a bounded number) are scored against every query first; a query's k-th
best of them is a bound that its search starts from. Queries are put in *blocks* by the
least length that can still matter to them, their bound over their own length, so that a
block meets the ranges down to its least such length only. A cell, one block and one
range, is one stream: the block's queries, then the range's rows by descending length.
Once the product of lengths falls below a query's k-th best score, the rest of the range
cannot enter. For what is left, the inner product over the leading coordinates plus the
product of the residual lengths (Cauchy-Schwarz) bounds the score; only survivors are
scored in full, in integers. Bounds carry a slack that covers the rounding.

Queries meet ranges by a shuffle, not through the driver: the driver gets the bases, the
seeds and two numbers per range and block. Several jobs run when the query is built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.store import Workspace

SCALE = 1024
#: Queries of a block and rows of a range, about. A cell holds a block and one batch of rows.
QUERY_BLOCK = 16_384
RANGE_ROWS = 16_384
#: The longest rows, scored against all queries first.
SEEDS = 1024
#: Queries and rows scored at once.
SCORED_QUERIES = 2048
SCORED_ROWS = 1024
#: Products of lengths below this leave every partial sum within 64 bits.
EXACT = float(1 << 62)

_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, no component that is null, NaN or infinite, also after scaling."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * SCALE) != F.lit(float("inf")))), F.lit(False))


def quantise(vector: Column) -> Column:
    """``floor(SCALE * x)`` of each component as a double, which holds it exactly: scaling by a power of two and flooring lose nothing."""
    y = lambda x: x.cast("double") * SCALE
    # beyond 2**53 a double is whole already, and floor() of Spark would squeeze it into a long
    return F.transform(vector, lambda x: F.when(F.abs(y(x)) < float(1 << 53), F.floor(y(x)).cast("double")).otherwise(y(x)))


def _by_width(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(width, rows, matrix)`` of a column of vectors, which are only compared with vectors as wide."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    starts = vectors.offsets.to_numpy()
    flat = vectors.values.to_numpy(zero_copy_only=False)
    widths = np.diff(starts)
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        yield int(width), at, flat[starts[at][:, None] + np.arange(width)]


def lengths(rows: np.ndarray) -> np.ndarray:
    """Euclidean lengths; of huge components too."""
    most = np.abs(rows).max(1, initial=1.0)
    return most * np.sqrt(((rows / most[:, None]) ** 2).sum(1))


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for width, _, rows in _by_width(batch.column(0)):
            unit = rows / np.maximum(lengths(rows), 1.0)[:, None]
            sums[width] = sums.get(width, 0) + unit.T @ unit
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([list(g.ravel()) for g in sums.values()], pa.list_(pa.float64()))], ["width", "gram"])


def _lead(width: int) -> int:
    return max(1, width // 4)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of huge rows; one beyond a long counts as the nearest long."""
    return np.array([min(max(sum(int(p) * int(q) for p, q in zip(x, y, strict=True)), _LOW + 1), _HIGH) for x, y in zip(a, b, strict=True)], np.int64)


class Search:
    """The k best rows seen so far for each of some queries; rows come by descending length.

    ``keys`` tell rows apart; a query is not its own partner. ``floor`` is a score that the
    result's k-th best is known to reach.
    """

    def __init__(self, queries: np.ndarray, keys: np.ndarray, basis: np.ndarray, k: int, floor: np.ndarray | None = None, slack: float = 1e-9):
        self.queries, self.keys, self.basis, self.k, self.slack = queries, keys, basis, k, slack
        self.length = lengths(queries)
        self.turned = queries @ basis
        self.lead = _lead(queries.shape[1])
        self.rest = lengths(self.turned[:, self.lead :]) if queries.shape[1] > self.lead else np.zeros(len(queries))
        self.floor = np.full(len(queries), _LOW) if floor is None else floor
        self.best = np.full((len(queries), k), _LOW)
        self.best_id = np.full((len(queries), k), _HIGH)
        self.bounded = self.scored = 0

    def feed(self, rows: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> bool:
        """Take rows no longer than any before; whether a shorter row could still enter."""
        with np.errstate(over="ignore", invalid="ignore"):
            for at in range(0, len(rows), SCORED_ROWS):
                part = slice(at, at + SCORED_ROWS)
                if not self._feed(rows[part], ids[part], keys[part]):
                    return False
        return True

    def _feed(self, rows: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> bool:
        length = lengths(rows)
        turned = rows @ self.basis
        rest = lengths(turned[:, self.lead :]) if rows.shape[1] > self.lead else np.zeros(len(rows))
        limit = np.maximum(self.best[:, -1], self.floor).astype(float)
        margin = self.slack * (1 + self.length * length[0])
        # where a bound overflows to no number, the comparison leaves the pair in
        open_ = np.flatnonzero(~(self.length * length[0] + margin < limit))
        for first in range(0, len(open_), SCORED_QUERIES):
            alive = open_[first : first + SCORED_QUERIES]
            bound = self.turned[alive, : self.lead] @ turned[:, : self.lead].T + np.outer(self.rest[alive], rest) + margin[alive, None]
            row, column = np.nonzero(~(bound < limit[alive, None]))
            row = alive[row]
            other = self.keys[row] != keys[column]
            row, column = row[other], column[other]
            self.bounded, self.scored = self.bounded + bound.size, self.scored + len(row)
            self._keep(alive, row, column, self._score(rows, row, column, self.length[row] * length[column]), ids)
        return len(open_) > 0

    def _score(self, rows: np.ndarray, row: np.ndarray, column: np.ndarray, size: np.ndarray) -> np.ndarray:
        score = np.empty(len(row), np.int64)
        for s in range(0, len(row), 1 << 16):
            part = slice(s, s + (1 << 16))
            exact = size[part] < EXACT
            a, b = self.queries[row[part]], rows[column[part]]
            found = np.einsum("ij,ij->i", np.where(exact[:, None], a, 0).astype(np.int64), np.where(exact[:, None], b, 0).astype(np.int64))
            if not exact.all():
                found[~exact] = _dot(a[~exact], b[~exact])
            score[part] = found
        return score

    def _keep(self, alive: np.ndarray, row: np.ndarray, column: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        enough = score >= self.floor[row]
        row, column, score = row[enough], column[enough], score[enough]
        if not len(row):
            return
        touched = np.unique(row)
        at = np.concatenate([row, np.repeat(touched, self.k)])
        score, found = np.concatenate([score, self.best[touched].ravel()]), np.concatenate([ids[column], self.best_id[touched].ravel()])
        sort = np.lexsort((found, ~score, at))  # ~ turns the order round without overflow
        at, score, found = at[sort], score[sort], found[sort]
        take = np.searchsorted(at, touched)[:, None] + np.arange(self.k)
        self.best[touched], self.best_id[touched] = score[take], found[take]

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query's place, row's id, score)``."""
        found = self.best > _LOW
        return np.nonzero(found)[0], self.best_id[found], self.best[found]


def _seeded(shared, k: int):
    """Queries (key, v) -> (key, v, floor, least): their k-th best score among the seeds, and the least length that can reach it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, bases = shared.value
        for batch in batches:
            floor, least = np.full(batch.num_rows, _LOW), np.zeros(batch.num_rows)
            for width, at, matrix in _by_width(batch.column(1)):
                search = Search(matrix, batch.column(0).to_numpy()[at], bases[width], k)
                if width in seeds:
                    rows, keys = seeds[width]
                    search.feed(rows, np.arange(len(rows)), keys)
                floor[at] = search.best[:, -1]
                with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                    need = floor[at] * (1 - 1e-6) / search.length
                least[at] = np.where((floor[at] > 0) & np.isfinite(need), need, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(floor), pa.array(least)], ["key", "v", "floor", "least"])

    return run


def _cells(shared, k: int, work: tuple | None):
    """Rows (block, range, query, key, id, floor, v), sorted by cell, queries first, then by descending length -> (key, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases = shared.value[1]
        cell, searches, waiting, open_ = None, {}, [], {}
        for batch in batches:
            block, range_, is_query = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            edges = np.flatnonzero((block[1:] != block[:-1]) | (range_[1:] != range_[:-1]) | (is_query[1:] != is_query[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if cell != (block[a], range_[a]):
                    yield from results(searches)
                    cell, searches, waiting, open_ = (block[a], range_[a]), {}, [], {}
                if is_query[a]:
                    waiting.append(part)
                    continue
                if waiting:
                    queries = pa.Table.from_batches(waiting)
                    for width, at, matrix in _by_width(queries["v"]):
                        searches[width] = Search(matrix, queries["key"].to_numpy()[at], bases[width], k, queries["floor"].to_numpy()[at])
                        open_[width] = True
                    waiting = []
                if not any(open_.values()):
                    continue
                ids, keys = part.column(4).to_numpy(zero_copy_only=False), part.column(3).to_numpy(zero_copy_only=False)
                for width, at, matrix in _by_width(part.column(6)):
                    if open_.get(width):
                        open_[width] = searches[width].feed(matrix, ids[at], keys[at])
        yield from results(searches)

    def results(searches: dict[int, Search]) -> Iterator[pa.RecordBatch]:
        for search in searches.values():
            if work:
                work[0].add(search.bounded)
                work[1].add(search.scored)
            place, ids, score = search.results()
            yield pa.RecordBatch.from_arrays([pa.array(search.keys[place]), pa.array(ids), pa.array(score)], ["key", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, query_block: int = QUERY_BLOCK, range_rows: int = RANGE_ROWS, seeds: int = SEEDS, work: tuple | None = None) -> DataFrame:
    """``query_row, query_id, rank, vec_id, score``: the k best other rows of each query row.

    Defined cases: rows with a null id, and vectors that are null, empty or hold null or
    non-finite components (also after scaling), take no part; vectors are compared with
    vectors of their own width only; ties go to the smaller id; a query with fewer than k
    others gets all of them. Rows that repeat an id are rows of their own: each of them
    that is a query has a ranking of its own, which ``query_row`` tells apart, and is a
    partner of the others. A score beyond a long counts, and is ranked, as the nearest
    long. An empty table gives an empty result; other columns are ignored. ``work`` may
    be two accumulators, of bounded and of scored pairs.
    """
    spark = vectors.sparkSession
    space = Workspace(spark, "topk")
    v = F.col("v")
    raw = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), quantise(F.col(vector_col)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    most = F.array_max(F.transform(v, F.abs))
    length = F.when(most > 0, most * F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.pow(x / most, F.lit(2.0))))).otherwise(F.lit(0.0))
    sized = space.put("sized", raw.withColumn("length", length))
    total, asking = sized.agg(F.count("*"), F.count_if("q")).first()
    if not asking:
        return spark.createDataFrame([], "query_row long, query_id long, rank int, vec_id long, score long")
    ordered = sized.repartitionByRange(-(-total // range_rows), F.desc("length"), "id").withColumns({"range": F.spark_partition_id(), "key": F.monotonically_increasing_id()})
    rows = _numbered(space.put("rows", ordered), "range", -(-total // range_rows))
    space.drop("sized")

    sums = rows.select("v").mapInArrow(_gram, "width int, gram array<double>").select("width", F.posexplode("gram").alias("at", "x")).groupBy("width", "at").agg(F.sum("x").alias("x"))
    bases = {}
    for width, gram in sums.groupBy("width").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("gram")).collect():
        bases[width] = np.linalg.eigh(np.array(gram).reshape(width, width))[1][:, ::-1].copy()
    longest = rows.orderBy(F.desc("length"), "id", "key").limit(seeds).select("key", "v").toArrow()
    shared = spark.sparkContext.broadcast(({w: (m, longest["key"].to_numpy()[at]) for w, at, m in _by_width(longest["v"])}, bases))

    asked = space.put("asked", rows.where("q").select("key", "v").mapInArrow(_seeded(shared, k), "key long, v array<double>, floor long, least double"))
    blocks = asked.repartitionByRange(-(-asking // query_block), F.desc("least"), "key").withColumn("block", F.spark_partition_id())
    blocks = _numbered(space.put("blocks", blocks), "block", -(-asking // query_block))
    # ranges come by descending length, so a block meets the first so many of them
    ends = rows.groupBy("range").agg(F.max("length").alias("longest"))
    reach = blocks.groupBy("block").agg(F.min("least").alias("least"))
    cells = space.put("cells", _meeting(ends, reach))
    one_of = blocks.join(cells, "block").select("block", "range", F.lit(True).alias("query"), "key", F.lit(0).cast("long").alias("id"), "floor", "v", F.lit(0.0).alias("length"))
    partners = rows.join(cells, "range").select("block", "range", F.lit(False).alias("query"), "key", "id", F.lit(0).cast("long").alias("floor"), "v", "length")
    met = one_of.unionByName(partners).repartition("block", "range").sortWithinPartitions("block", "range", F.desc("query"), F.desc("length"), "id")
    found = met.drop("length").mapInArrow(_cells(shared, k, work), "key long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), F.asc("vec_id")))
    best = found.withColumn("rank", place).where(F.col("rank") <= k)
    names = rows.where("q").select("key", F.col("id").alias("query_id"))
    return best.join(names, "key").select(F.col("key").alias("query_row"), "query_id", "rank", "vec_id", "score")


def _numbered(rows: DataFrame, column: str, most: int) -> DataFrame:
    """``column`` from 0 to ``most`` - 1 at most, in the same order, if Spark has made more partitions than asked for."""
    parts = rows.agg(F.max(column)).first()[0] + 1
    return rows.withColumn(column, F.floor(F.col(column) * most / parts).cast("int")) if parts > most else rows


def _meeting(ends: DataFrame, reach: DataFrame) -> DataFrame:
    """``block, range``: each block with the ranges, 0 to the last, that hold a row as long as it asks for.

    The driver gets one number a range, 8 bytes for ``RANGE_ROWS`` rows.
    """
    known = dict(ends.toLocalIterator())
    falling = np.full(max(known) + 1, -np.inf)
    falling[list(known)] = list(known.values())
    falling = -np.maximum.accumulate(falling[::-1])[::-1]  # an empty range is as long as the next

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = np.searchsorted(falling, -batch.column(1).to_numpy(), "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(last.astype(np.int32))], ["block", "last"])

    found = reach.select("block", "least").mapInArrow(run, "block int, last int").where("last >= 0")
    return found.select("block", F.explode(F.sequence(F.lit(0), "last")).alias("range"))
