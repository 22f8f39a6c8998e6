"""The whole tracking pipeline on synthetic recordings, images, and small spatial cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import pipeline
from tessera.operators import filters, images, spatial
from tessera.sources import files


def recordings(spark, sessions=7, objects=12, seed=0):
    rng = np.random.default_rng(seed)
    centres = [(8 + 16 * (k // 4), 8 + 16 * (k % 4)) for k in range(objects)]
    feature = rng.normal(size=(objects, 8)) * 3
    prints, rois, vectors = [], [], []
    for s in range(sessions):
        for k, (cy, cx) in enumerate(centres):
            r = s * objects + k
            y0, x0 = cy + int(rng.integers(-1, 2)), cx + int(rng.integers(-1, 2))
            rois.append((r, s, k, y0, x0))
            vectors.append((r, [float(v) for v in feature[k] + rng.normal(size=8)]))
            prints += [(r, s, (y0 + a) * 64 + x0 + b, float(np.exp(-(a * a + b * b) / 18))) for a in range(-6, 7) for b in range(-6, 7)]
            neighbour = centres[(k + 1) % objects]
            prints.append((r, s, neighbour[0] * 64 + neighbour[1], 0.4))
    return (
        spark.createDataFrame(prints, "roi_id long, session_id int, pixel long, weight double"),
        spark.createDataFrame(rois, "roi_id long, session_id int, roi_idx long, cy long, cx long"),
        spark.createDataFrame(vectors, "roi_id long, vec array<double>"),
    )


@pytest.mark.parametrize("method", ["density", "sequential"])
def test_objects_are_tracked(spark, method, tmp_path):
    footprint, roi, vectors = recordings(spark)
    params = {"frame": {"height": 64, "width": 64}, "normalization": {"k_min": 1, "k_max": 6}, "mixing": {"method": "manual", "powers": {"sf": 1.0, "nn": 0.3}}, "pruning": {"d_cutoff": 0.6}, "clustering": {"method": method}}
    found = pipeline.track(footprint, roi, {"nn": vectors}, params)
    assert filters.session_violations(found.labels).isEmpty()
    truth = found.labels.join(roi.select("roi_id", "roi_idx"), "roi_id")
    pure = truth.where("label >= 0").groupBy("label").agg(F.countDistinct("roi_idx").alias("k"), F.count("*").alias("n")).collect()
    assert len(pure) >= 10 and all(r["k"] == 1 for r in pure) and sum(r["n"] for r in pure) >= 70
    if method == "density":
        found.save(f"file://{tmp_path}/out")
        again = files.Archive(spark, f"file://{tmp_path}/out")
        assert again["labels"].count() == 84 and again.manifest()["params"]["fitted"]["method"] == "density"
        assert not pipeline.good_samples(found).isEmpty()
        assert pipeline.align_traces(found, roi.select("session_id", "roi_idx", F.col("cy").alias("v")), roi).where("v IS NOT NULL").count() >= 70


def test_automatic_mixing_runs(spark):
    footprint, roi, vectors = recordings(spark, sessions=4)
    found = pipeline.track(footprint, roi, {"nn": vectors}, {"frame": {"height": 64, "width": 64}, "normalization": {"k_min": 1, "k_max": 6}, "mixing": {"generations": 5}})
    assert set(found.params["fitted"]["metrics"]) == {"s_sf", "s_nn"} and found.labels.count() == 48
    with pytest.raises(KeyError):
        pipeline.track(footprint, roi, {}, {"no_such": 1})


def test_convolution_modes(spark):
    rng = np.random.default_rng(4)
    image = np.where(rng.random((7, 8)) < 0.4, rng.random((7, 8)), 0)
    entries = spark.createDataFrame([(0, 0, int(y * 8 + x), float(image[y, x])) for y, x in zip(*np.nonzero(image), strict=True)], "roi_id long, session_id int, pixel long, weight double")
    kernel = spark.createDataFrame([(a, b, float(1 + a + 2 * b + 3)) for a in (-1, 0, 1) for b in (-1, 0, 1)], "dy int, dx int, k double")
    full = np.zeros((9, 10))
    for y, x in zip(*np.nonzero(image), strict=True):
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                full[y + a + 1, x + b + 1] += image[y, x] * (4 + a + 2 * b)
    for mode, want in (("full", full), ("same", full[1:-1, 1:-1]), ("valid", full[2:-2, 2:-2])):
        out = np.zeros_like(want)
        for r in spatial.convolve(entries, kernel, 7, 8, mode).collect():
            out[divmod(r["pixel"], want.shape[1])] = r["weight"]
        assert np.allclose(out, want), mode


def test_image_functions(spark):
    rng = np.random.default_rng(1)
    image = rng.random((36, 36))
    assert np.allclose(images.scale_about_centre(image, 1.0), image)
    y, x = np.mgrid[:36, :36].astype(float)
    assert np.allclose(images.resample(image, y, x, "nearest"), image) and np.allclose(images.resample(image, y, x, "bilinear"), image)
    even = images.clahe(image, (4, 4))
    assert 0 <= even.min() and even.max() <= 1 + 1e-9
    table = spark.createDataFrame([(k, [float(v) for v in rng.random(36 * 36)]) for k in range(5)], "roi_id long, img array<double>")
    latents = images.scattering_latents(table, 36, 36, angles=4)
    assert latents.count() == 5 and latents.select(F.size("vec")).distinct().count() == 1
    assert images.normalise_scale(table, 1.0, 36, 36).where("size(img) <> 1296").isEmpty()


def test_polygon_and_warps(spark):
    points = spark.createDataFrame([(1.0, 1.0), (1.0, 5.0), (3.0, 1.0)], "y double, x double")
    assert points.where(spatial.in_polygon(F.col("y"), F.col("x"), [(0.0, 0.0), (0.0, 4.0), (4.0, 0.0)])).collect() == [(1.0, 1.0)]
