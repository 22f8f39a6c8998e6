"""Masks, class filters, set operations, de-duplication, deterministic sampling, reduction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.checkpoints import cut
from tessera.operators.order import numbered, placed_in_strata, running_total


#: Values of ``hash_order``, and the ranges that a stratum is split into.
HASHES = 1_000_003
CELLS = 1000
#: Strata whose bounds are sent to every task.
FEW_STRATA = 100_000


def sparse_mask(x: DataFrame, *masks: DataFrame) -> DataFrame:
    """Entries of ``x(i, j, ...)`` whose place is in every mask; stored zeros of ``x`` stay."""
    for mask in masks:
        x = x.join(mask.select("i", "j"), ["i", "j"], "left_semi")
    return x


def pattern_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("i", "j").union(b.select("i", "j")).distinct()


def pattern_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("i", "j").intersect(b.select("i", "j"))


def unmatched(rows: DataFrame, matched: DataFrame, key: str = "roi_id") -> DataFrame:
    return rows.join(matched.select(key).distinct(), key, "left_anti")


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """``key, side``: keys of one table only."""
    only = lambda x, y, side: x.select(key).distinct().join(y.select(key).distinct(), key, "left_anti").withColumn("side", F.lit(side))
    return only(a, b, "left").unionByName(only(b, a, "right"))


def by_class(rows: DataFrame, keep: list | None = None, remove: list | None = None, column: str = "label") -> DataFrame:
    """Exactly one of ``keep`` and ``remove``."""
    if (keep is None) == (remove is None):
        raise ValueError("give either the classes to keep or those to remove")
    return rows.where(F.col(column).isin(keep)) if keep is not None else rows.where(~F.col(column).isin(remove))


def keep_classes(tables: dict[str, DataFrame], labels: DataFrame, keep: list | None = None, remove: list | None = None) -> dict[str, DataFrame]:
    """All tables without the objects of some classes: exactly one of ``keep`` and ``remove``.

    ``tables["roi"]`` has ``roi_id, session_id, roi_idx``; every table with a ``roi_id`` loses
    the objects that go, and the others are numbered anew, in their old order and without gaps,
    in ``roi_id`` and within their session in ``roi_idx``. ``labels(roi_id, label)`` comes back
    as table ``labels`` with ``class_index``, the place of the class among those left. Objects
    without a label go. Tables without a ``roi_id`` are passed on.
    """
    left = by_class(labels, keep, remove).where("label IS NOT NULL").select("roi_id", "label")
    places = numbered(tables["roi"].select("roi_id", "session_id", "roi_idx").join(left, "roi_id"), "session_id", "roi_idx", "roi_id", out="__id")
    first = places.groupBy("session_id").agg(F.min("__id").alias("__first"))
    places = cut(places.join(F.broadcast(first), "session_id").select("roi_id", "label", "__id", (F.col("__id") - F.col("__first")).alias("__idx")))  # one row a session
    classes = numbered(places.select("label").distinct(), "label", out="class_index", kind="int")
    out = {}
    for name, rows in tables.items():
        if "roi_id" in rows.columns:
            joined = rows.join(places.select("roi_id", "__id", "__idx"), "roi_id")
            rows = joined.select(*(F.col("__id").alias(c) if c == "roi_id" else F.col("__idx").alias(c) if c == "roi_idx" else c for c in rows.columns))
        out[name] = rows
    out["labels"] = places.join(F.broadcast(classes), "label").select(F.col("__id").alias("roi_id"), "label", "class_index")  # one row a class
    return out


def canonical_rows(x: DataFrame) -> DataFrame:
    """``i, j, ...`` with each row's entries together in one partition and in the order of ``j``: for sinks that read rows in turn."""
    return x.repartition("i").sortWithinPartitions("i", "j")


def least_cluster_size(labels: DataFrame, k: int, column: str = "label") -> DataFrame:
    """Labels with fewer than ``k`` members become -1. Sizes are aggregated first, so a huge cluster is not one task's."""
    big = labels.groupBy(column).agg(F.count("*").alias("__n")).where(F.col("__n") >= k).select(column, F.lit(True).alias("__keep"))
    return labels.join(big, column, "left").withColumn(column, F.when(F.col("__keep"), F.col(column)).otherwise(F.lit(-1))).select(*labels.columns)


def session_violations(labels: DataFrame, column: str = "label") -> DataFrame:
    """``label, n, sessions`` of the clusters that hold two objects of one session."""
    per = labels.where(F.col(column) >= 0).groupBy(column).agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"))
    return per.where("n > sessions")


def first_entry(x: DataFrame, order: str = "pos") -> DataFrame:
    """Of entries at one place, the first by ``order``."""
    rest = [c for c in x.columns if c not in ("i", "j")]
    return x.groupBy("i", "j").agg(F.min_by(F.struct(*rest), F.col(order)).alias("__r")).select("i", "j", *(F.col(f"__r.{c}").alias(c) for c in rest))


def merge_first(parts: list[DataFrame], drop_zeros: bool = True) -> DataFrame:
    """Blocks stacked in order; the first block that has a place gives its value."""
    out = None
    for k, part in enumerate(parts):
        part = part.withColumn("pos", F.lit(k))
        out = part if out is None else out.unionByName(part)
    merged = first_entry(out, "pos").drop("pos")
    return merged.where("s <> 0") if drop_zeros else merged


def sparse_diff(a: DataFrame, b: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Places where two sparse matrices differ; an absent entry counts as 0."""
    both = a.select("i", "j", F.col("s").alias("a")).join(b.select("i", "j", F.col("s").alias("b")), ["i", "j"], "full")
    x, y = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return both.select("i", "j", x.alias("a"), y.alias("b")).where(F.abs(F.col("a") - F.col("b")) > F.lit(atol) + F.abs(F.col("b")) * rtol)


def hash_order(*columns: str, modulus: int = HASHES) -> Column:
    """A fixed scrambling that other engines can compute too."""
    total = F.lit(0).cast("bigint")
    for k, c in enumerate(columns):
        total = total + F.col(c).cast("bigint") * (7919 + 104_729 * k)
    return F.pmod(total, F.lit(modulus))


def stratified_sample(rows: DataFrame, strata: str, n: int, keys: tuple[str, ...] = ("i", "j"), least: int = 100) -> DataFrame:
    """About ``n`` rows, each stratum in proportion and at least ``least``: the first by a hash of the keys.

    A first pass counts the ranges of the hash in each stratum; only rows of the ranges that reach
    its share are kept and ranked, range by range, so a stratum that holds most rows is split.
    """
    width = HASHES // CELLS + 1
    by = hash_order(*keys)
    cells = cut(rows.groupBy(strata, F.floor(by / width).cast("int").alias("__cell")).agg(F.count("*").alias("__n")))
    total = cells.agg(F.sum("__n")).first()[0] or 0
    whole = Window.partitionBy(strata)
    share = F.greatest(F.floor(F.sum("__n").over(whole) * n / max(total, 1)), F.lit(least))
    ahead = F.coalesce(F.sum("__n").over(whole.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    limit = cut(cells.withColumns({"__take": share, "__ahead": ahead}).where("__ahead < __take").groupBy(strata).agg(F.max("__cell").alias("__last"), F.first("__take").alias("__take")))
    few = limit.count() <= FEW_STRATA
    near = rows.join(F.broadcast(limit) if few else limit, strata).where(F.floor(by / width) <= F.col("__last"))
    placed = placed_in_strata(cut(near), strata, by, keys, CELLS, width)
    return placed.where("__place <= __take").select(*rows.columns)


def stratified_split(rows: DataFrame, label: str, key: str, test_size: float = 0.3) -> DataFrame:
    """``is_test``: the first rows of each class by a hash, ``test_size`` of them. A large class is split as above."""
    placed = placed_in_strata(rows, label, hash_order(key), (key,), CELLS, HASHES // CELLS + 1)
    return placed.select(*rows.columns, (F.col("__place") <= F.round(F.col("__size") * test_size)).alias("is_test"))


def some_per_label(rows: DataFrame, label: str, key: str, k: int) -> DataFrame:
    return rows.withColumn("__p", F.row_number().over(Window.partitionBy(label).orderBy(hash_order(key), key))).where(F.col("__p") <= k).drop("__p")


def quantile_ladder(rows: DataFrame, column: str, steps: int) -> DataFrame:
    """``step, value``: values at ``steps`` even ranks, in between by linear interpolation; nulls do not count.

    Distinct values are numbered by ranges, with the count of each; each takes the ranks it
    holds, two for a step.
    """
    counts = numbered(rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n")), "v", out="k")
    ends = running_total(counts, "k", "n", "end")
    total = rows.agg(F.count(column)).first()[0]
    ranks = [k / max(steps - 1, 1) * (total - 1) for k in range(steps)] if total else []
    wanted = rows.sparkSession.createDataFrame([(k, int(r), min(int(r) + 1, total - 1), r - int(r)) for k, r in enumerate(ranks)], "step int, low long, high long, part double")
    needed = F.array(*(F.lit(r).cast("long") for r in sorted({x for r in ranks for x in (int(r), min(int(r) + 1, total - 1))})))
    picked = ends.select("v", F.explode(F.filter(needed, lambda r: (r < F.col("end")) & (r >= F.col("end") - F.col("n")))).alias("rank")).select("rank", "v")
    low, high = picked.toDF("low", "a"), picked.toDF("high", "b")
    return wanted.join(low, "low").join(high, "high").select("step", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("value"))


def batches(rows: DataFrame, order: str, size: int, least: int = 1) -> DataFrame:
    """``batch`` by rows of the given order; a short last batch is dropped if below ``least``.

    ``order`` must be a dense 0-based index, so no global window is needed.
    """
    out = rows.withColumn("batch", F.floor(F.col(order) / size).cast("bigint"))
    full = out.groupBy("batch").agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select("batch")
    return out.join(full, "batch", "left_semi")


def make_smaller(footprint: DataFrame, roi: DataFrame, n_rois: int, n_sessions: int, width: int, y: tuple[int, int], x: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """First sessions, first objects of each, pixels inside the bounds; objects without weight left are dropped."""
    some = roi.where(F.col("session_id") < n_sessions).withColumn("__k", F.row_number().over(Window.partitionBy("session_id").orderBy("roi_id"))).where(F.col("__k") <= n_rois).drop("__k")
    py, px = F.floor(F.col("pixel") / width), F.col("pixel") % width
    inside = footprint.join(some.select("roi_id"), "roi_id", "left_semi").where((py >= y[0]) & (py < y[1]) & (px >= x[0]) & (px < x[1]))
    left = inside.where("weight > 0").select("roi_id").distinct()
    return inside, some.join(left, "roi_id", "left_semi")
