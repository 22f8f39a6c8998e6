from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import topk

from .common import with_clashes

COLUMNS = ["query_id", "rank", "vec_id", "score"]
LONG = (-(2**63) + 1, 2**63 - 1)


def brute(rows, k=10):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(1024 * x) for x in v)]
    out = []
    for a, (q, x) in enumerate(ok):
        if q % 100 == 0:
            score = lambda y: min(max(sum(p * r for p, r in zip(x, y, strict=True)), LONG[0]), LONG[1])  # noqa: E731,B023
            best = sorted((-score(y), i) for b, (i, y) in enumerate(ok) if a != b and len(x) == len(y))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def table(spark, rows, kind="float"):
    return with_clashes(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"))


def found(spark, rows, kind="float", **sizes):
    got = topk.top_k(table(spark, rows, kind), F.col("vec_id") % 100 == 0, **sizes)
    return sorted(map(tuple, got.select(*COLUMNS).collect()))


def test_scores_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(900, 16)).astype(np.float32) * rng.gamma(2, 1, (900, 1)).astype(np.float32)
    v[100:140] = v[100]  # ties
    rows = [(k, [float(x) for x in v[k]]) for k in range(900)] + [(1000, [float("nan")] * 16), (1100, None), (1200, []), (1300, [None] * 16), (1400, [float("inf")] * 16), (1500, [1.0, 2.0]), (1501, [2.0, -1.0]), (None, [1.0] * 16), (1600, [0.0] * 16)]
    want = brute(rows)
    assert found(spark, rows) == want
    assert found(spark, rows, query_block=3, range_rows=50, seeds=20) == want


def test_repeated_ids_are_rows_of_their_own(spark):
    rng = np.random.default_rng(2)
    rows = [(k // 3 * 50, [float(x) for x in rng.normal(size=4)]) for k in range(120)]
    rows += rows[:9]
    assert found(spark, rows, query_block=7, range_rows=20, seeds=5) == brute(rows)
    got = topk.top_k(table(spark, rows), F.col("vec_id") == 0)
    assert got.select("query_row").distinct().count() == 6 and got.count() == 60


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(size=3) * 10.0 ** rng.integers(-2, 9)]) for k in range(200)]
    rows += [(200, [1e30, 0.0, -1.0]), (201, [0.0, 2.0, 3.0]), (300, [-1e30, 1e30, 0.5]), (301, [2e5, 1e12, -1e12]), (400, [1e300, 1e-300, 1.0]), (401, [1e308, 0.0, 0.0]), (500, [3e15, -3e15, 9e15])]
    assert found(spark, rows, "double") == brute(rows)
    assert found(spark, rows, "double", query_block=2, range_rows=30, seeds=4) == brute(rows)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0]), (1, [-1.0]), (2, [1.0])]
    assert found(spark, rows) == [(0, 1, 2, 1048576), (0, 2, 1, -1048576)]
    assert topk.top_k(table(spark, rows), F.col("vec_id") == 9).count() == 0
    assert topk.top_k(table(spark, rows).limit(0), F.col("vec_id") == 0).count() == 0


def test_bounds_prune_without_loss(spark):
    """The longest rows come first everywhere and their scores carry over, so most pairs are never scored."""
    rng = np.random.default_rng(1)
    scale = np.r_[np.full(4, 4.0), np.full(12, 0.1)]
    v = rng.normal(size=(3000, 16)) * scale * rng.gamma(1, 1, (3000, 1))
    rows = [(k, [float(x) for x in v[k]]) for k in range(3000)]
    work = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    got = topk.top_k(table(spark, rows, "double"), F.col("vec_id") % 100 == 0, range_rows=500, work=work)
    assert sorted(map(tuple, got.select(*COLUMNS).collect())) == brute(rows)
    pairs = 30 * 3000
    assert 0 < work[1].value < 0.2 * pairs and work[0].value < 0.7 * pairs
