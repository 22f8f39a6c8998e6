"""Queries that SQL cannot express, against plain versions of the same; and plans without one-task or nested-loop nodes."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import calibrate, filters, graph, ids, kernels, similarity, spatial
from tessera.operators.order import numbered
from tessera.plans import graphs, registry
from tessera.sources import files
from tessera.sources import harness as H


def run(spark, sf_dir, name):
    return registry.queries()[name](spark, sf_dir).toPandas()


def test_noise_rescue_equals_one_global_pass(spark, sf_dir):
    edges = graphs.distances(spark, sf_dir).where("inter").toPandas()
    roi = H.roi(spark, sf_dir).toPandas().sort_values("roi_id")
    owned = roi[roi.label >= 0].groupby(["session_id", "label"]).roi_id.min()
    label = np.where(roi.roi_id.isin(owned), roi.label, -1)
    session = dict(zip(roi.roi_id, roi.session_id, strict=True))
    old = dict(zip(roi.roi_id, label, strict=True))
    group = {i: {i} for i in old}
    for name in set(old.values()) - {-1}:
        mine = {i for i in old if old[i] == name}
        for i in mine:
            group[i] = mine
    near = edges[(edges.i < edges.j) & (edges.d <= 0.62)]
    for r in near.sort_values(["d", "i", "j"]).itertuples():
        a, b = group[r.i], group[r.j]
        if (old[r.i] >= 0 and old[r.j] >= 0) or a is b or {session[x] for x in a} & {session[x] for x in b}:
            continue
        both = a | b
        for x in both:
            group[x] = both
    got = dict(run(spark, sf_dir, "noise_rescue")[["roi_id", "label"]].itertuples(index=False))
    assert set(got) == set(old)
    for i, mine in group.items():
        named = [x for x in mine if old[x] >= 0]
        if named:
            assert got[i] == old[max(named)]
        else:
            assert (got[i] == -1) == (len(mine) == 1) and all(got[x] == got[i] for x in mine)
    fresh = {got[i] for i, mine in group.items() if len(mine) > 1 and not any(old[x] >= 0 for x in mine)}
    first = max(old.values()) + 1
    assert fresh == set(range(first, first + len(fresh)))


def test_rescued_objects_join_old_clusters():
    found = kernels.rescue([(0, 0, 0), (1, 1, 1), (2, 2, -1)], [(0.1, 0, 2), (0.2, 1, 2)], 0.5)
    assert set(found.values()) == {(0, 1)}


def test_isotonic_fit_is_the_greatest_of_least_means():
    rng = np.random.default_rng(0)
    for _ in range(30):
        y, w = rng.normal(size=12), rng.random(12) + 0.1
        mean = lambda a, b: float((y[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum())  # noqa: E731,B023
        want = [max(min(mean(a, b) for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
        assert calibrate.isotonic(y, w) == pytest.approx(want)


def test_pca_equals_the_covariance_spectrum(spark, sf_dir):
    x = np.stack(H.latent(spark, sf_dir, "nn").toPandas()["vec"])
    spectrum = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    got = run(spark, sf_dir, "pca_variance").sort_values("component")
    assert got["variance"].to_numpy() == pytest.approx(spectrum[:5], abs=2e-6)
    assert got["ratio"].to_numpy() == pytest.approx(spectrum[:5] / spectrum.sum(), abs=2e-6)


def test_mutual_matches_equal_a_plain_search(spark, sf_dir):
    table = H.table(spark, sf_dir, "embeddings").toPandas().sort_values("vec_id")
    x = np.stack(table["embedding"]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    key = table["vec_id"].to_numpy()
    even, odd = key % 2 == 0, key % 2 == 1

    def passing(left, right):
        out = {}
        for i in np.flatnonzero(left):
            d = np.sqrt(np.maximum(2 - 2 * x[right] @ x[i], 0))
            order = np.lexsort((key[right], d))
            p = [0.5 * math.erfc((d.mean() - d[order[k]]) / d.std(ddof=1) / math.sqrt(2)) for k in (0, 1)]
            if p[0] < 0.05 and p[1] > 10 * p[0]:
                out[key[i]] = key[right][order[0]]
        return out

    forth, back = passing(even, odd), passing(odd, even)
    want = sorted((t, m) for t, m in forth.items() if back.get(m) == t)
    got = run(spark, sf_dir, "mutual_nn_match")
    assert sorted(zip(got["t"], got["m"], strict=True)) == want


def test_donuts_of_crowded_places(spark):
    rng = np.random.default_rng(1)
    points = [(k, 5, 5) for k in range(200)] + [(200 + k, int(y), int(x)) for k, (y, x) in enumerate(rng.integers(0, 400, (150, 2)))] + [(400, 10_000, 10_000)]
    got = similarity.knn_donut(spark.createDataFrame(points, "roi_id long, cy long, cx long"), 3, 12).collect()
    want = []
    for i, y, x in points:
        near = sorted(((y - v) ** 2 + (x - w) ** 2, j) for j, v, w in points)
        want += [(i, j, r) for r, (_, j) in enumerate(near, 1) if 3 < r <= 12]
    assert sorted((r["i"], r["j"], r["rank"]) for r in got) == sorted(want)


def test_numbers_samples_and_splits(spark):
    rows = spark.range(3000).select(F.col("id").alias("i"), (F.col("id") * 7 % 3000).alias("j"), F.when(F.col("id") % 50 == 0, "b").otherwise("a").alias("s"))
    assert sorted(map(tuple, numbered(rows, "j").select("j", "place").collect())) == [(k, k) for k in range(3000)]
    hashes = {r["i"]: (r["h"], r["i"]) for r in rows.select("i", filters.hash_order("i").alias("h")).collect()}
    split = {r["i"]: r["is_test"] for r in filters.stratified_split(rows, "s", "i", 0.3).collect()}
    for part in ([k for k in range(3000) if k % 50], [k for k in range(3000) if k % 50 == 0]):
        first = set(sorted(part, key=hashes.get)[: round(0.3 * len(part))])
        assert {k for k in part if split[k]} == first
    few = filters.stratified_sample(rows, "s", 600, ("i",), 30).groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in few} == {"a": 588, "b": 30}
    ladder = [r["value"] for r in filters.quantile_ladder(rows, "j", 7).orderBy("step").collect()]
    assert ladder == pytest.approx(np.quantile(np.arange(3000), np.linspace(0, 1, 7)).tolist())
    assert filters.quantile_ladder(rows.limit(0), "j", 3).count() == 0


def test_plans_have_no_single_task_windows_or_nested_loops(spark, sf_dir):
    roi, footprint = H.roi(spark, sf_dir), H.footprint(spark, sf_dir)
    points = roi.select("roi_id", F.col("cy").cast("double").alias("y"), F.col("cx").cast("double").alias("x"))
    labels = H.ucid(spark, sf_dir)
    found = {
        "knn": similarity.knn_donut(roi, 2, 6),
        "cosine": similarity.dense_cosine(H.latent(spark, sf_dir, "nn"), 0.5),
        "members": spatial.block_members(footprint, spatial.tiles(spark, 60, 40, 16, 16, 0.2), 40),
        "grid": spatial.nearest_grid(points, spark, 10, 20.0, 492.0, 40.0).drop("gy", "gx"),
        "sample": filters.stratified_sample(labels, "session_id", 100, ("roi_idx",)),
        "split": filters.stratified_split(labels, "session_id", "roi_idx"),
        "ladder": filters.quantile_ladder(roi, "cy", 5),
        "squeeze": ids.squeeze_ucids(labels),
        "factorize": ids.factorize(labels, "ucid"),
        "integers": scalar.squeeze_integers(labels, "roi_idx"),
        "dense": graph._dense_ids(roi.select("roi_id", F.col("label").cast("bigint").alias("root"))),
    }
    for name, rows in found.items():
        plan = rows._jdf.queryExecution().executedPlan().toString()
        nested = plan.count("NestedLoop") + plan.count("CartesianProduct")
        assert nested <= (1 if name in ("members", "grid") else 0), name  # tiles and grid points are products of two axes
        assert "Exchange SinglePartition" not in plan or name in ("ladder", "members", "grid"), name  # sums of one block each


def test_stat_files_keep_their_sessions(spark, tmp_path):
    paths = [f"{tmp_path}/s{k}/suite2p/plane0/stat.npy" for k in range(3)]
    for k, path in enumerate(paths):
        files.write_stat(spark, path, [{"ypix": [k], "xpix": [1], "lam": [2.0]}] * (k + 1))
    got = files.read_stat(spark, paths[::-1])
    assert sorted((r["session_id"], r["roi_idx"], r["ypix"]) for r in got.collect()) == sorted((2 - k, i, [k]) for k in range(3) for i in range(k + 1))


def _weight(method, d):
    d = abs(d)
    if method == "linear":
        return max(1 - d, 0.0)
    if method == "cubic":
        return 1.25 * d**3 - 2.25 * d**2 + 1 if d <= 1 else -0.75 * (d**3 - 5 * d**2 + 8 * d - 4) if d < 2 else 0.0
    return float(np.sinc(d) * np.sinc(d / 4)) if d < 4 else 0.0


def _sampled(img, at, method, border, value):
    """One value of ``img`` at ``at``, axis by axis over a padded copy."""
    pad = 40
    modes = {"replicate": {"mode": "edge"}, "reflect": {"mode": "symmetric"}, "wrap": {"mode": "wrap"}, "constant": {"mode": "constant", "constant_values": value}}
    wide = np.pad(img, pad, **modes[border])
    if method == "nearest":
        y, x = (int(np.floor(c + 0.5)) + pad for c in at)
        return wide[y, x]
    weights = [np.array([_weight(method, c + pad - k) for k in range(n)]) for c, n in zip(at, wide.shape, strict=True)]
    return float((weights[0] / weights[0].sum()) @ wide @ (weights[1] / weights[1].sum()))


@pytest.mark.parametrize("border", ["constant", "replicate", "reflect", "wrap"])
def test_remapping_equals_sampling_a_padded_image(spark, border):
    rng = np.random.default_rng(6)
    img = rng.random((5, 7))
    image = spark.createDataFrame([(0, y, x, float(img[y, x])) for y in range(5) for x in range(7)], "session_id int, y long, x long, v double")
    places = [(float(a), float(b)) for a, b in rng.uniform(-9, 16, (30, 2))] + [(0.0, 0.0), (2.5, -0.5), (4.0, 6.0), (-7.0, 20.0)]
    remap = spark.createDataFrame([(0, k, 0, sy, sx) for k, (sy, sx) in enumerate(places)] + [(0, 99, 0, None, 1.0), (0, 98, 0, 1.0, math.nan)], "session_id int, y long, x long, sy double, sx double")
    for method in ("nearest", "linear", "cubic", "lanczos"):
        got = {r["y"]: r["v"] for r in spatial.remap_image(image, remap, method, border, 2.0 if border == "constant" else 0.0, (5, 7)).collect()}
        assert sorted(got) == list(range(len(places)))
        np.testing.assert_allclose([got[k] for k in range(len(places))], [_sampled(img, at, method, border, 2.0) for at in places], atol=1e-9)


def test_remapping_refuses_what_it_does_not_know(spark):
    rows = spark.createDataFrame([], "session_id int, y long, x long, v double")
    remap = spark.createDataFrame([], "session_id int, y long, x long, sy double, sx double")
    for arguments in ({"method": "spline"}, {"border": "mirror"}, {"border": "wrap"}, {"value": 1.0}):
        with pytest.raises(ValueError):
            spatial.remap_image(rows, remap, **arguments)
    assert spatial.remap_image(rows, remap, "lanczos", "wrap", frame=(3, 3)).count() == 0
