"""Registration of sessions: warps from matched points or images, chained to a template.

A warp is a 3x3 matrix in a row-major array of nine. There is one a session, so tables of
warps are small; images and point sets are work of one task a pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.align import ransac, register_pairs
from tessera.operators.spatial import compose

IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)


def identity() -> Column:
    return F.array(*(F.lit(v) for v in IDENTITY))


def null_registration(sessions: DataFrame) -> DataFrame:
    """``session_id, m``: no session is moved."""
    return sessions.select("session_id", identity().alias("m"))


def fit_points(points: DataFrame, kind: str = "euclidean", threshold: float = 2.0, trials: int = 200, seed: int = 0) -> DataFrame:
    """``a, b, m, n_points, n_inside``: the warp of each pair that takes ``(x, y)`` closest to ``(u, v)``.

    ``points(a, b, x, y, u, v)`` are the matches of a pair of images. Rows with a null are left
    out; the fit does not depend on the rows' order; with too few points it is the identity.
    """
    if kind not in ("euclidean", "similarity", "affine", "homography"):
        raise ValueError(f"unknown kind of warp: {kind}")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = part.sort_values(["x", "y", "u", "v"])
        m, inside = ransac(rows[["x", "y"]].to_numpy(float), rows[["u", "v"]].to_numpy(float), kind, threshold, trials, seed)
        return pd.DataFrame({"a": [rows["a"].iloc[0]], "b": [rows["b"].iloc[0]], "m": [m.ravel().tolist()], "n_points": [len(rows)], "n_inside": [int(np.sum(inside))]})

    whole = points.select("a", "b", *(F.col(c).cast("double").alias(c) for c in "xyuv")).dropna()
    return whole.groupBy("a", "b").applyInPandas(run, "a int, b int, m array<double>, n_points long, n_inside long")


def template_place(template: float | int, n: int) -> int:
    """Which of ``n`` sessions is the template: an index, or a share of the way through them."""
    at = int(n * template) if isinstance(template, float) else template
    if isinstance(template, float) and not 0.0 <= template <= 1.0:
        raise ValueError("a share must be between 0 and 1")
    at = min(at, n - 1) if isinstance(template, float) else at
    if not 0 <= at < n:
        raise ValueError("there is no such session")
    return at


def chain_to_template(warps: DataFrame, template: int) -> DataFrame:
    """``session_id, m``: each session's warp to the template, from ``warps(session_id, m)`` to its neighbour.

    Neighbours are nearer the template: sessions before it are given against the next, sessions
    after it against the one before. The template's own warp comes last in each product.
    """
    every = warps.agg(F.array_sort(F.collect_list(F.struct("session_id", "m"))).alias("all"))  # one row a session
    before = F.filter("all", lambda w: (w["session_id"] >= F.col("session_id")) & (w["session_id"] <= F.lit(template)))
    after = F.reverse(F.filter("all", lambda w: (w["session_id"] <= F.col("session_id")) & (w["session_id"] >= F.lit(template))))
    path = F.when(F.col("session_id") <= template, before).otherwise(after)
    product = F.aggregate("path", identity(), lambda done, w: compose(w["m"], done))
    return warps.select("session_id").crossJoin(F.broadcast(every)).withColumn("path", path).select("session_id", product.alias("m"))


def shift_warp(dy: Column, dx: Column) -> Column:
    """The warp of a shift."""
    return F.array(F.lit(1.0), F.lit(0.0), dx.cast("double"), F.lit(0.0), F.lit(1.0), dy.cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def fit_geometric(fov: DataFrame, height: int, width: int, template: float | int = 0.5, method: str = "sequential", radius: int = 4, z_threshold: float = 4.0, low: float = 0.0, high: float = 0.0) -> DataFrame:
    """``session_id, m, z_in, aligned``: shifts of ``fov(session_id, img)`` to a template session.

    ``sequential`` registers each session to its neighbour on the template's side and chains
    the warps, ``image`` registers each to the template. A step passes if its ``z_in`` reaches
    the threshold; a session is aligned if all its steps pass. The template has no ``z_in``.
    """
    if method not in ("sequential", "image"):
        raise ValueError(f"unknown method: {method}")
    ids = [r[0] for r in fov.select("session_id").distinct().orderBy("session_id").collect()]  # one a session
    at = template_place(template, len(ids))
    toward = [(ids[k], ids[at] if method == "image" else ids[k + (1 if k < at else -1)]) for k in range(len(ids)) if k != at]
    pairs = fov.sparkSession.createDataFrame([(to, s) for s, to in toward], "a int, b int")
    steps = register_pairs(fov, pairs, height, width, radius, low, high).select(F.col("b").alias("session_id"), shift_warp(F.col("dy"), F.col("dx")).alias("m"), "z_in", (F.col("z_in") >= z_threshold).alias("aligned"))
    own = fov.where(F.col("session_id") == ids[at]).select("session_id", identity().alias("m"), F.lit(None).cast("double").alias("z_in"), F.lit(True).alias("aligned"))
    each = steps.unionByName(own)
    if method == "image":
        return each
    passed = each.agg(F.collect_list(F.when(~F.col("aligned"), F.col("session_id"))).alias("failed"))
    between = lambda x: ((x >= F.col("session_id")) & (x <= F.lit(ids[at]))) | ((x <= F.col("session_id")) & (x >= F.lit(ids[at])))
    whole = each.select("session_id", "z_in").crossJoin(F.broadcast(passed)).select("session_id", "z_in", (~F.exists("failed", between)).alias("aligned"))
    return chain_to_template(each.select("session_id", "m"), ids[at]).join(whole, "session_id").select("session_id", "m", "z_in", "aligned")
