"""Queries use their whole tables, not a prefix of the ids."""

from __future__ import annotations

import random

from tessera.operators import calibrate as C
from tessera.plans import registry


def footprints(spark, at, pixels):
    """A directory with one supplier per session and its ``(pixel, weight)``."""
    spark.createDataFrame([(k, k) for k in range(len(pixels))], "s_suppkey long, s_nationkey int").write.parquet(f"{at}/supplier.parquet")
    rows = [(k, p, w) for k, own in enumerate(pixels) for p, w in own]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{at}/lineitem.parquet")
    return str(at)


def test_pixels_of_the_whole_frame_are_registered_and_warped(spark, tmp_path):
    rng = random.Random(3)
    blob = [(y, x, float(rng.randint(1, 9))) for y in range(60, 75) for x in range(10, 25)]
    d = footprints(spark, tmp_path, [[((y + s * 3) * 40 + x + s * 2, w) for y, x, w in blob] for s in (0, 1)])
    got = {r["session_id"]: (abs(r["dy"]), abs(r["dx"])) for r in registry.queries()["phase_correlation"](spark, d).collect()}
    assert got == {0: (0, 0), 1: (3, 2)}
    moved = registry.queries()["warp_footprints"](spark, d).where("session_id = 0").collect()
    assert {r["pixel"] for r in moved} == {(y + 2) * 40 + x + 1 for y, x, _ in blob}
    drawn = registry.queries()["remap_bilinear"](spark, d).where("v > 0").collect()
    assert max(r["y"] for r in drawn) == 76


def test_running_best_is_carried_over_all_ranges(spark):
    rng = random.Random(4)
    rows = [(k, None if k < 25 or k % 7 == 0 else 1000.0 - k + rng.random() * 90) for k in range(400)]
    table = spark.createDataFrame(rows, "k long, v double")
    got = sorted(map(tuple, C.running_best_whole(table, "k", "v", 20).select("k", "best", "span").collect()))
    best, want = [], []
    for k, v in rows:
        best.append(min((x for x in (v, best[-1] if best else None) if x is not None), default=None))
        recent = [x for x in best[-20:] if x is not None]
        want.append((k, best[-1], max(recent) - min(recent) if recent else None))
    assert got == want
    assert C.running_best_whole(table.limit(0), "k", "v", 20).count() == 0


def test_running_best_whole_has_a_row_per_order(spark, sf_dir):
    assert registry.queries()["running_best"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
