"""Overlapping footprints and their metrics from where blocks meet: the same edges as by joins, and none of them stored."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import pipeline
from tessera.operators import overlap, similarity


def table(spark, odd=True):
    rng = np.random.default_rng(3)
    rows = [(k, k % 3, int(k * 5 + q), float(w)) for k in range(70) for q, w in zip(rng.choice(40, 9, replace=False), rng.random(9), strict=True)]
    rows += [(70, 0, int(p), float(p % 7)) for p in range(0, 390, 3)]  # reaches over all blocks
    if odd:
        rows += [(1, 1, 30, None), (2, 2, None, 0.7), (3, 0, 30, -4.0), (4, 1, 30, 0.5), (4, 1, 30, 0.25), (None, 0, 30, 1.0), (71, 2, 30, 0.0), (72, 0, None, 1.0), (73, 1, 2**40, 3.0), (74, 2, 2**40, 4.0), (75, 0, 2**40, math.inf)]
    return spark.createDataFrame(rows, "roi_id long, session_id int, pixel long, weight double")


def features(spark, n=75):
    rng = np.random.default_rng(4)
    return {k: spark.createDataFrame([(r, [float(v) for v in rng.normal(size=5)]) for r in range(2, n)], "roi_id long, vec array<double>") for k in ("a", "b")}


def same_rows(got, want):
    rows = [sorted(x.select("i", "j", *(c for c in got.columns if c.startswith("s_")), "inter").collect(), key=lambda r: (r["i"], r["j"])) for x in (got, want)]
    assert [(r["i"], r["j"], r["inter"]) for r in rows[0]] == [(r["i"], r["j"], r["inter"]) for r in rows[1]] and rows[0]
    for c in (c for c in got.columns if c.startswith("s_")):
        assert np.allclose(*([r[c] for r in x] for x in rows), rtol=1e-9, atol=1e-12, equal_nan=True), c


def test_packed_footprints_hold_every_entry(spark):
    f = table(spark)
    got = overlap.unpack(overlap.pack(f)).select("roi_id", "pixel", "weight")
    want = f.where("roi_id IS NOT NULL").select("roi_id", "pixel", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert overlap.unpack(overlap.pack(f.limit(0))).isEmpty()


@pytest.mark.parametrize(("pixels", "power"), [(None, 1.0), (60, 1.0), (200, 2.0)])
def test_edges_where_blocks_meet_are_those_of_the_joins(spark, pixels, power):
    rows, f = table(spark), features(spark)
    roi = rows.where("roi_id IS NOT NULL AND roi_id <> 60").select("roi_id", "session_id").distinct()
    stats = {k: spark.createDataFrame([(r, 0.1 + r / 1000, 0.5 + r / 900) for r in range(70) if r % (6 + n)], "i long, mu double, sd double") for n, k in enumerate(f)}
    want = similarity.inter_session(similarity.footprint_similarity(rows, power, directed=True).withColumnRenamed("s", "s_sf"), roi)
    objects = roi.withColumn("scored", F.lit(True))
    for k, vectors in f.items():
        want = similarity.zscore(similarity.masked_cosine(want, vectors, f"s_{k}"), stats[k], f"s_{k}", f"s_{k}")
        objects = overlap.vector_columns(objects, vectors, stats[k], k)
    packed = overlap.pack(rows)
    got = overlap.overlap_edges(packed, objects, list(f), power, pixels)
    same_rows(got, want)
    if pixels == 60:
        assert overlap.blocks(packed.where("n > 0"), 60).agg(F.max("block")).first()[0] > 8


@pytest.mark.parametrize("together", [1, 50, 10**6])
def test_shared_pixels_are_summed_alike_however_they_are_dealt(together):
    rng = np.random.default_rng(9)
    n, wide = 40, 400
    dense = np.where(rng.random((2, n, wide)) < 0.02, rng.random((2, n, wide)), 0)
    dense[0, 7] = rng.random(wide)
    sides = []
    for x in dense:
        row, pixel = np.nonzero(x)
        sides.append({"id": np.arange(n), "row": row, "pixel": pixel, "weight": x[row, pixel]})
    for a, b in ((0, 1), (0, 0)):
        want = np.minimum(dense[a][:, None], dense[b][None]).sum(2)
        if a == b:
            want = np.triu(want, 1)
        got = np.zeros((n, n))
        for r, c, s in overlap._shared(sides[a], sides[b], a == b, together):
            assert not got[r, c].any()
            got[r, c] = s
        assert np.allclose(got, np.where(want < similarity.LEAST_SIMILARITY, 0, want))


def placed(rows):
    return rows.where("roi_id IS NOT NULL").select("roi_id", "session_id").distinct().withColumns({"cy": F.col("roi_id"), "cx": F.col("roi_id") % 7})


def test_tracking_writes_no_edge_but_the_pruned(spark, monkeypatch):
    written = []
    for name in ("cut", "stored"):
        keep = getattr(pipeline, name, None)
        monkeypatch.setattr(pipeline, name, lambda x, f=keep: written.append((x.columns, x.count())) or f(x), raising=False)
    rows = table(spark, odd=False)
    params = {"normalization": {"k_min": 1, "k_max": 3}, "mixing": {"method": "manual"}, "pruning": {"d_cutoff": 0.55}}
    found = pipeline.track(rows, placed(rows), {"nn": features(spark)["a"]}, params)
    assert found.labels.count() == 71
    edges = [n for columns, n in written if "s_sf" in columns]
    assert edges == [found.edges.count()] and 0 < edges[0] < found.sims.count()
    assert found.clusters.agg(F.sum("n")).first()[0] == 71 and found.samples.count() == 71


def test_repeated_or_missing_rows_are_put_together_by_joins(spark):
    rows, vectors = table(spark, odd=False), features(spark)["a"]
    params = pipeline.config.prepare({"normalization": {"k_min": 1, "k_max": 3}}, pipeline.DEFAULTS)
    once = pipeline.similarity_graph(rows, placed(rows), {"nn": vectors}, params)
    nothing = vectors.unionByName(spark.createDataFrame([(0, None)], vectors.schema))
    assert pipeline.similarity_graph(rows, placed(rows), {"nn": nothing}, params).where("i > 1 AND j > 1").select("i", "j").exceptAll(once.select("i", "j")).isEmpty()
    twice = vectors.unionByName(vectors.where("roi_id = 5"))
    n = once.where("i = 5 OR j = 5").count()
    assert n > 0 and pipeline.similarity_graph(rows, placed(rows), {"nn": twice}, params).count() == once.count() + n
    packed = pipeline.similarity_graph(overlap.pack(rows), placed(rows), {"nn": vectors}, params)
    same_rows(packed, once)
    blurred = params | {"blur": {"half_width": 2}, "frame": {"height": 20, "width": 20}}
    same_rows(pipeline.similarity_graph(overlap.pack(rows), placed(rows), {}, blurred), pipeline.similarity_graph(rows, placed(rows), {}, blurred))
