"""From similarities to a pruned graph: histograms, calibration, mixing, crossover, cutoff.

Everything over edges is an aggregate into a fixed number of bins; what the driver sees is
a bin table. Bin edges are doubles.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import scalar as S
from tessera.operators.checkpoints import cut


def default_bins(n_edges: int) -> tuple[int, int]:
    """``(bins, smoothing window)`` for a number of edges."""
    bins = max(min(n_edges // 10_000, 200), 20)
    window = bins // 10
    return bins, window + 1 if window % 2 == 0 else window


def bin_index(x: Column, low: float | Column, high: float | Column, n: int) -> Column:
    """0-based bin of ``n`` even ones; right-open but for the last; null outside."""
    low, high = (c if isinstance(c, Column) else F.lit(float(c)) for c in (low, high))
    k = F.floor((x - low) / (high - low) * n).cast("int")
    return F.when((x < low) | (x > high), F.lit(None).cast("int")).when(x == high, F.lit(n - 1)).otherwise(k)


def bin_lookup(x: Column, low: float | Column, high: float | Column, n: int) -> Column:
    """Bin for reading a table: a value on an inner edge falls to the bin below; clamped to the range."""
    low, high = (c if isinstance(c, Column) else F.lit(float(c)) for c in (low, high))
    k = F.ceil((x - low) / (high - low) * n).cast("int") - 1
    return F.least(F.greatest(k, F.lit(0)), F.lit(n - 1))


def histogram(rows: DataFrame, column: str, low: float, high: float, n: int, where: Column | None = None, out: str = "n") -> DataFrame:
    """``bin, n`` for every bin, empty ones too."""
    counts = (rows.where(where) if where is not None else rows).select(bin_index(F.col(column), low, high, n).alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias(out))
    spine = rows.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counts, "bin", "left").withColumn(out, F.coalesce(out, F.lit(0).cast("bigint")))


def boxcar(bins: DataFrame, column: str, window: int, out: str) -> DataFrame:
    """Centred moving average, shorter at the ends. ``bins`` has a fixed number of rows."""
    half = window // 2
    return bins.withColumn(out, F.avg(column).over(Window.orderBy("bin").rowsBetween(-half, half)))


def reverse_cumulative_max(bins: DataFrame, column: str, out: str) -> DataFrame:
    return bins.withColumn(out, F.max(column).over(Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)))


def running_best(trials: DataFrame, order: str, value: str, patience: int) -> DataFrame:
    """``best`` so far and ``span`` of the best over the last ``patience`` trials (one tuning run's log)."""
    w = Window.orderBy(order)
    best = trials.withColumn("best", F.min(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    recent = w.rowsBetween(-(patience - 1), 0)
    return best.withColumn("span", F.max("best").over(recent) - F.min("best").over(recent))


def running_best_whole(trials: DataFrame, order: str, value: str, patience: int) -> DataFrame:
    """``running_best`` of a log of any length: best and row number per range of ``order``, carried over the ranges.

    The best never rises, so the largest of the last ``patience`` is the earliest of them.
    What reaches the driver is one row per range.
    """
    kept = cut(trials.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy("_part").orderBy(order)
    local = kept.withColumns({"_low": F.min(value).over(own.rowsBetween(Window.unboundedPreceding, 0)), "_at": F.row_number().over(own).cast("long")})
    parts = kept.groupBy("_part").agg(F.count("*").alias("n"), F.min(value).alias("low"), F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("head")).orderBy("_part").collect()
    first = next((r["head"] for r in parts if r["head"] is not None), None)
    carried, before, low = [], 0, None
    for r in parts:
        carried.append((r["_part"], before, low))
        before += r["n"]
        low = min((x for x in (low, r["low"]) if x is not None), default=None)
    kind = kept.schema[value].dataType.simpleString()
    carry = trials.sparkSession.createDataFrame(carried, f"_part int, _before long, _carried {kind}")
    best = local.join(F.broadcast(carry), "_part").withColumns({"best": F.least("_low", "_carried"), "_at": F.col("_at") + F.col("_before")}).drop("_part", "_low", "_before", "_carried")
    old = best.select((F.col("_at") + (patience - 1)).alias("_at"), F.col("best").alias("_old"))
    return best.join(old, "_at", "left").withColumn("span", F.coalesce("_old", F.lit(first).cast(kind)) - F.col("best")).drop("_at", "_old")


def neighbour_difference(rows: DataFrame, partition: str, order: str, value: str) -> DataFrame:
    return rows.withColumn("diff", F.col(value) - F.lag(value).over(Window.partitionBy(partition).orderBy(order)))


def bin_counts(edges: DataFrame, bounds: dict[str, tuple[float, float]], n: int) -> DataFrame:
    """``metric, bin, n_all, n_intra, least`` for each column of ``bounds``: all of them in one pass over edges ``(inter, <columns>)``, kept.

    ``bin`` is null for values outside; ``least`` is the least value.
    """
    each = [F.struct(F.lit(c).alias("metric"), bin_index(F.col(c), *b, n).alias("bin"), F.col(c).cast("double").alias("v")) for c, b in bounds.items()]
    rows = edges.select((~F.col("inter")).alias("intra"), F.explode(F.array(*each)).alias("x")).select("intra", "x.*")
    return cut(rows.groupBy("metric", "bin").agg(F.count("*").alias("n_all"), F.count_if("intra").alias("n_intra"), F.min("v").alias("least")))


def value_bounds(edges: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Range of each column with a small margin, in one pass."""
    found = edges.agg(*(f(c).alias(f"{c}{k}") for c in columns for k, f in enumerate((F.min, F.max)))).first()
    return {c: ((found[f"{c}0"] or 0.0) - 1e-6, (found[f"{c}1"] or 0.0) + 1e-6) for c in columns}


def same_diff_bins(edges: DataFrame, column: str, n: int, window: int, low: float | None = None, high: float | None = None, smooth: str = "diff", counts: DataFrame | None = None) -> DataFrame:
    """``bin, n_all, n_intra, diff, same, diff_smooth, same_smooth``: one aggregate over edges ``(inter, column)``.

    Pairs of one session are known to differ; scaled up they estimate all that differ, and
    what remains, where positive, is the same. Without bounds, the data's range with a small
    margin is used. ``counts``: ``bin_counts`` with these bounds, if at hand.
    """
    if low is None or high is None:
        low, high = value_bounds(edges, [column])[column]
    if counts is None:
        counts = bin_counts(edges, {column: (low, high)}, n)
    counts = counts.where(F.col("metric") == column).drop("metric", "least")
    totals = counts.agg(F.sum("n_all").alias("t_all"), F.sum("n_intra").alias("t_intra"))
    spine = edges.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"), F.lit(low).alias("low"), F.lit(high).alias("high"))
    bins = spine.join(counts.where("bin IS NOT NULL"), "bin", "left").fillna(0, ["n_all", "n_intra"]).crossJoin(F.broadcast(totals))
    scale = F.coalesce(F.try_divide(F.col("t_all").cast("double"), F.col("t_intra")), F.lit(0.0))
    bins = bins.withColumn("diff", F.col("n_intra") * scale)
    bins = bins.withColumn("same", F.greatest(F.col("n_all") - F.col("diff"), F.lit(0.0))).drop("t_all", "t_intra")
    return boxcar(boxcar(bins, "diff", window, "diff_smooth"), "same", window, "same_smooth")


def p_same(bins: DataFrame) -> DataFrame:
    """Raw probability of being the same, per bin, before the monotone fit."""
    return bins.withColumn("p_same", F.col("same") / (F.col("same") + F.col("diff_smooth") + 1e-10))


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted least-squares fit that never falls (pools of adjacent violators)."""
    level, mass, size = [], [], []
    for value, w in zip(y.tolist(), weight.tolist(), strict=True):
        level.append(value)
        mass.append(w)
        size.append(1)
        while len(level) > 1 and level[-2] > level[-1]:
            w2, w1 = mass.pop(), mass.pop()
            v2, v1 = level.pop(), level.pop()
            level.append((v1 * w1 + v2 * w2) / (w1 + w2))
            mass.append(w1 + w2)
            size.append(size.pop() + size.pop())
    return np.repeat(level, size)


def calibrate_features(edges: DataFrame, columns: list[str], n: int, window: int, clip: tuple[float, float] = (1e-4, 1 - 1e-4)) -> dict[str, list[dict]]:
    """``calibrate_feature`` of several metrics, in two passes over the edges however many they are."""
    bounds = value_bounds(edges, columns)
    counts = bin_counts(edges, bounds, n)
    out = {}
    for column in columns:
        rows = [r.asDict() for r in p_same(same_diff_bins(edges, column, n, window, *bounds[column], counts=counts)).orderBy("bin").collect()]
        weight = np.maximum([r["n_all"] + r["diff_smooth"] for r in rows], 1e-10)
        fitted = np.clip(isotonic(np.array([r["p_same"] for r in rows]), weight), *clip)
        for r, p in zip(rows, fitted, strict=True):
            r["p"] = float(p)
        out[column] = rows
    return out


def calibrate_feature(edges: DataFrame, column: str, n: int, window: int, clip: tuple[float, float] = (1e-4, 1 - 1e-4)) -> list[dict]:
    """The bin table of one metric with its monotone ``p`` (``n`` rows, fitted on the driver)."""
    return calibrate_features(edges, [column], n, window, clip)[column]


def naive_bayes(edges: DataFrame, tables: dict[str, list[dict]], clip: tuple[float, float] = (1e-4, 1 - 1e-4)) -> DataFrame:
    """Edges with ``p_same`` and ``d``: log-odds of the metrics' bins added, the prior counted once.

    Each bin table is a literal array, so the lookup is an expression, not a join.
    """
    priors = []
    for rows in tables.values():
        same, diff = sum(r["same"] for r in rows), sum(r["diff_smooth"] for r in rows)
        if same + diff > 0:
            priors.append(same / (same + diff))
    prior = min(max(float(np.mean(priors)) if priors else 0.5, clip[0]), clip[1])
    total = F.lit(-(len(tables) - 1) * math.log(prior / (1 - prior)))
    for column, rows in tables.items():
        logit = F.array(*(F.lit(math.log(r["p"] / (1 - r["p"]))) for r in rows))
        total = total + F.get(logit, bin_lookup(F.col(column), rows[0]["low"], rows[0]["high"], len(rows)))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-total))
    return edges.withColumn("p_same", p).withColumn("d", F.lit(1.0) - F.col("p_same"))


def fisher_sigmoid(bins: DataFrame, n: int, n_mu: int = 50, n_b: int = 30) -> DataFrame:
    """``mu, b, fisher``: the logistic of a grid that best parts same from different (bins x grid, fixed size)."""
    spark = bins.sparkSession
    step = (F.col("high") - F.col("low")) / n
    mid = bins.withColumn("c", F.col("low") + (F.col("bin") + 0.5) * step)
    one = Window.partitionBy()
    mid = mid.select(
        "c", (F.col("same") / (F.sum("same").over(one) + 1e-10)).alias("ws"), (F.col("diff_smooth") / (F.sum("diff_smooth").over(one) + 1e-10)).alias("wd"), F.min("c").over(one).alias("c0"), F.max("c").over(one).alias("c1")
    )
    grid = spark.range(n_mu * n_b).select(F.col("id").alias("g"), F.floor(F.col("id") / n_b).alias("km"), (F.lit(0.5) + (F.col("id") % n_b) * F.lit(9.5 / (n_b - 1))).alias("b"))
    both = grid.crossJoin(F.broadcast(mid)).withColumn("mu", F.col("c0") + F.col("km") * (F.col("c1") - F.col("c0")) / (n_mu - 1))
    both = both.withColumn("v", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("b") * (F.col("c") - F.col("mu")))))
    m = both.groupBy("g", "mu", "b").agg(*(F.sum(F.col(w) * x).alias(name) for w, x, name in (("ws", F.col("v"), "ms"), ("wd", F.col("v"), "md"), ("ws", F.col("v") ** 2, "qs"), ("wd", F.col("v") ** 2, "qd"), ("ws", F.lit(1.0), "ts"), ("wd", F.lit(1.0), "td"))))
    # sum w (v - m)^2 = q - 2 m m + m^2 t
    var = lambda k: F.col(f"q{k}") - F.col(f"m{k}") ** 2 * 2 + F.col(f"m{k}") ** 2 * F.col(f"t{k}")
    scored = m.withColumn("fisher", (F.col("ms") - F.col("md")) ** 2 / (var("s") + var("d") + 1e-12))
    return scored.agg(F.max(F.struct(F.round("fisher", 9).alias("f"), (-F.col("g")).alias("k"), "mu", "b", "fisher")).alias("r")).select("r.mu", "r.b", "r.fisher")


def conjunctive(edges: DataFrame, metrics: dict[str, dict], p: float) -> DataFrame:
    """Edges with ``sim`` (power mean of the activated metrics) and ``d = 1 - sim``; the metrics' settings make the plan."""
    parts = [S.activation(F.col(name), **settings) for name, settings in metrics.items()]
    return edges.withColumn("sim", S.p_norm(parts, p)).withColumn("d", F.lit(1.0) - F.col("sim"))


def crossover(edges: DataFrame, n: int, window: int, column: str = "d", counts: DataFrame | None = None) -> DataFrame:
    """``d_crossover, overlap``: the edge after the last bin, before the different peak, where the same is denser.

    One row; null and an overlap of 1e6 if there is no such bin.
    """
    bins = same_diff_bins(edges, column, n, window, 0.0, 1.0, counts=counts)
    one = Window.partitionBy()
    peak = F.min_by("bin", F.struct(-F.col("diff"), F.col("bin"))).over(one)
    marked = bins.withColumn("peak", peak)
    return marked.agg(F.max(F.when((F.col("bin") < F.col("peak")) & (F.col("diff") < F.col("same_smooth")), F.col("bin"))).alias("k"), F.sum(F.col("same_smooth") * F.col("diff")).alias("o")).select(
        ((F.col("k") + 1) / F.lit(float(n))).alias("d_crossover"), F.when(F.col("k").isNull(), F.lit(1e6)).otherwise(F.col("o")).alias("overlap")
    )


def prune(edges: DataFrame, stringency: float = 1.0, d_cutoff: float | None = None, n: int = 20, window: int = 3, column: str = "d") -> DataFrame:
    """Edges strictly below the cutoff: given, or ``min + (crossover - min) * stringency``; none if there is no crossover.

    The cutoff takes one pass over the edges, the result another; the edges are not stored.
    """
    if d_cutoff is None:
        counts = bin_counts(edges, {column: (0.0, 1.0)}, n)
        cross = crossover(edges, n, window, column, counts).first()["d_crossover"]
        least = counts.agg(F.min("least")).first()[0]
        if cross is None or least is None:
            return edges.limit(0)
        d_cutoff = least + (cross - least) * stringency
    return edges.where(F.col(column) < d_cutoff)


def monotone_probability(bins: DataFrame, n: int, window: int) -> DataFrame:
    """``bin, x, p``: probability of the same at each bin's lower edge, never rising with distance, 0 at the end."""
    smooth = boxcar(bins, "diff", window, "ds").withColumn("raw", F.coalesce(F.try_divide(F.col("same_smooth"), F.col("same_smooth") + F.col("ds")), F.lit(0.0)))
    mono = reverse_cumulative_max(smooth, "raw", "p").select("bin", (F.col("bin") / F.lit(float(n))).alias("x"), "p")
    return mono.unionByName(bins.sparkSession.range(1).select(F.lit(n).alias("bin"), F.lit(1.0).alias("x"), F.lit(0.0).alias("p")))


def to_probability(edges: DataFrame, table: list[float], column: str = "d") -> DataFrame:
    """Edges with ``sim`` interpolated in the ``n + 1`` values of ``monotone_probability`` and ``d = 1 - sim``, clipped to 0..1."""
    n = len(table) - 1
    values = F.array(*(F.lit(float(v)) for v in table))
    at = F.least(F.greatest(F.col(column), F.lit(0.0)), F.lit(1.0)) * n
    k = F.least(F.floor(at), F.lit(n - 1)).cast("int")
    sim = F.get(values, k) + (F.get(values, k + 1) - F.get(values, k)) * (at - k)
    return edges.withColumn("sim", sim).withColumn(column, F.lit(1.0) - F.col("sim"))
