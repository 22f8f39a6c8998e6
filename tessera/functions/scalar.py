"""Column functions: activations, mixing, scaling, encoding, small numeric helpers.

All of them are built-in Spark expressions, so they stay inside whole-stage codegen;
only the normal distribution's tails (no ``erf`` in Spark SQL) go through an Arrow UDF.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.order import numbered

TINY = 1e-12


def generalised_logistic(x: Column, a: float = 0.0, k: float = 1.0, b: float = 1.0, v: float = 1.0, q: float = 1.0, c: float = 1.0, mu: float = 0.0) -> Column:
    """``a + (k - a) / (c + q * exp(-b * (x - mu))) ** (1 / v)``."""
    return F.lit(a) + F.lit(k - a) / F.pow(F.lit(c) + F.lit(q) * F.exp(F.lit(-b) * (x - F.lit(mu))), F.lit(1.0 / v))


def activation(s: Column, mu: float | None = None, b: float | None = None, power: float | None = None, floor: float = 0.0) -> Column:
    """Optional logistic, clamp at ``floor``, optional power."""
    out = generalised_logistic(s, b=b, mu=mu or 0.0) if b is not None else s
    out = F.greatest(out, F.lit(floor))
    return F.pow(out, F.lit(power)) if power is not None else out


def p_norm(values: Sequence[Column], p: float) -> Column:
    """Power mean of order ``p`` (0 stands for 1e-9). A zero under a negative order gives 0."""
    p = p or 1e-9
    total = sum((F.pow(v, F.lit(p)) for v in values[1:]), F.pow(values[0], F.lit(p)))
    return F.pow(total / F.lit(float(len(values))), F.lit(1.0 / p))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    n = l2_norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def snap_to_one(s: Column, eps: float = 1e-5) -> Column:
    """Values above ``1 - eps`` become 1."""
    return F.when(s > 1 - eps, F.lit(1.0)).otherwise(s)


def minmax_scale(image: Column, eps: float = 1e-9) -> Column:
    low = F.array_min(image).cast("double")
    span = F.array_max(image).cast("double") - low + F.lit(eps)
    return F.transform(image, lambda x: (x.cast("double") - low) / span)


def scale_sum(image: Column, total: float = 1.0, eps: float = 1e-9, subtract_min: bool = True) -> Column:
    low = F.array_min(image).cast("double") if subtract_min else F.lit(0.0)
    shifted = F.transform(image, lambda x: x.cast("double") - low)
    whole = F.aggregate(shifted, F.lit(0.0), lambda s, x: s + x)
    return F.transform(shifted, lambda x: x * F.lit(total) / (whole + F.lit(eps)))


def clip_image(image: Column, low: float, high: float) -> Column:
    return F.transform(image, lambda x: clip(x.cast("double"), low, high))


def standardise(image: Column, mean: float, std: float) -> Column:
    return F.transform(image, lambda x: (x.cast("double") - F.lit(mean)) / F.lit(std))


def to_rgb(gray: Column) -> Column:
    return F.array_repeat(gray, 3)


def nan_to(x: Column, value: float = 0.0) -> Column:
    return F.nanvl(x, F.lit(value))


def image_flags(image: Column) -> Column:
    """``(has_nan, has_inf, all_zero)`` of an image."""
    return F.struct(
        F.exists(image, lambda x: F.isnan(x)).alias("has_nan"),
        F.exists(image, lambda x: F.abs(x) == F.lit(float("inf"))).alias("has_inf"),
        F.forall(image, lambda x: x == 0).alias("all_zero"),
    )


def make_odd(n: Column, up: bool = True) -> Column:
    return n + F.when(n % 2 == 0, 1 if up else -1).otherwise(0)


def make_even(n: Column, up: bool = True) -> Column:
    return n + F.when(n % 2 == 0, 0).otherwise(1 if up else -1)


def log_spaced(low: float, high: float, n: int) -> Column:
    """``n`` values from ``low`` to ``high``, evenly apart in the logarithm, ends exact."""
    a, b = math.log(low), math.log(high)
    inner = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(k == 0, F.lit(low)).when(k == n - 1, F.lit(high)).otherwise(F.exp(F.lit(a) + F.lit(b - a) * k / F.lit(max(n - 1, 1)))))
    return inner


def one_hot(index: Column, n: int, value: float = 1.0) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(k == index, F.lit(value)).otherwise(F.lit(0.0)))


def digits(text: Column) -> Column:
    """All digits of a string, joined, as a number; null without any."""
    found = F.regexp_replace(text, "[^0-9]", "")
    return F.when(found != "", found).cast("bigint")


def flat_index(y: Column, x: Column, width: int) -> Column:
    return y.cast("bigint") * F.lit(width) + x


def unravel(index: Column, width: int) -> tuple[Column, Column]:
    return F.floor(index / F.lit(width)).cast("bigint"), index % F.lit(width)


def reshape(i: Column, j: Column, old_width: int, new_width: int) -> tuple[Column, Column]:
    """Row and column of a sparse entry after a row-major reshape, in 64-bit arithmetic."""
    return unravel(flat_index(i, j, old_width), new_width)


def squeeze_integers(rows: DataFrame, column: str, out: str = "squeezed") -> DataFrame:
    """Dense relabelling from the minimum on, order kept: ``[7,2,7,4,-1,0] -> [3,1,3,2,-1,0]``.

    The distinct values are numbered on their own, by ranges, then joined back. Nulls stay null.
    """
    ranked = numbered(rows.select(column).where(F.col(column).isNotNull()).distinct(), column, out=out)
    least = rows.agg(F.min(column)).first()[0]
    return rows.join(ranked.withColumn(out, F.col(out) + F.lit(least or 0)), column, "left")


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """``label, n, weight``: rows over the label's count."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select(label, "n", (F.col("total") / F.col("n")).alias("weight"))


def sample_weights(rows: DataFrame, label: str) -> DataFrame:
    """Each row with its label's weight; the small weight table is looked up."""
    return rows.join(class_weights(rows, label).drop("n"), label)


@F.pandas_udf(T.DoubleType())
def _two_tailed(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)), na_action="ignore")


@F.pandas_udf(T.DoubleType())
def _one_tailed(z: pd.Series) -> pd.Series:
    return z.map(lambda v: 0.5 * math.erfc(v / math.sqrt(2)), na_action="ignore")


@F.pandas_udf(T.DoubleType())
def _quantile(p: pd.Series) -> pd.Series:
    inverse = NormalDist().inv_cdf
    return p.map(lambda v: inverse(v) if 0 < v < 1 else (math.inf if v >= 1 else -math.inf), na_action="ignore")


def zscore_to_pvalue(z: Column, two_tailed: bool = True) -> Column:
    return _two_tailed(z) if two_tailed else _one_tailed(z)


def pvalue_to_zscore(p: Column, two_tailed: bool = True) -> Column:
    return _quantile(F.lit(1.0) - (p / 2 if two_tailed else p))


def distance_grid(spark, height: int, width: int, p: float = 2.0, center: tuple[float, float] | None = None) -> DataFrame:
    """``y, x, d``: Minkowski distance of each grid point to the centre."""
    cy, cx = center if center is not None else ((height - 1) / 2, (width - 1) / 2)
    ys = spark.range(height).select(F.col("id").cast("int").alias("y"))
    grid = ys.select("y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    dy, dx = F.abs(F.col("y") - F.lit(cy)), F.abs(F.col("x") - F.lit(cx))
    d = F.greatest(dy, dx) if math.isinf(p) else F.pow(F.pow(dy, F.lit(p)) + F.pow(dx, F.lit(p)), F.lit(1.0 / p))
    return grid.select("y", "x", d.alias("d"))


def cosine_kernel(spark, center: tuple[int, int] = (5, 5), height: int = 11, width: int = 11, cycle: float = 5.0) -> DataFrame:
    """``y, x, v``: one raised cosine of full width ``cycle`` around ``center`` (y, x)."""
    grid = distance_grid(spark, height, width, 2.0, center)
    phase = F.least(F.col("d") / F.lit(cycle / 2) * F.lit(math.pi), F.lit(math.pi))
    return grid.select("y", "x", ((F.cos(phase) + 1) / 2).alias("v"))
