"""Literal cases and plan shapes of the DataFrame operators."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import filters, graph, ids, quality, similarity, spatial
from tessera.sources import files


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_squeeze_keeps_order_from_the_minimum(spark):
    got = S.squeeze_integers(spark.createDataFrame([(k, v) for k, v in enumerate([7, 2, 7, 4, -1, 0])], "k int, v int"), "v")
    assert [r[1] for r in rows(got, "k", "squeezed")] == [3, 1, 3, 2, -1, 0]


def test_power_mean_with_zero_under_a_negative_order(spark):
    got = spark.range(1).select(S.p_norm([F.lit(0.0), F.lit(0.5)], -1.0), S.p_norm([F.lit(0.25), F.lit(0.25)], 0)).first()
    assert got[0] == 0.0 and got[1] == pytest.approx(0.25)


def test_quality_of_an_asymmetric_graph(spark):
    edges = spark.createDataFrame([(0, 1, 0.8), (0, 2, 0.9), (1, 0, 0.8), (2, 0, 0.2), (2, 3, 0.8), (3, 2, 0.8)], "i long, j long, s double")
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (4, 7)], "roi_id long, label int")
    got = {r["label"]: r for r in quality.cluster_quality(edges, labels).collect()}
    assert got[0]["silhouette"] == pytest.approx(-1 / 9) and got[1]["silhouette"] == pytest.approx(0.75)
    assert got[7]["intra_mean"] is None and got[7]["intra_min"] == 1.0


def test_silhouette_equals_the_dense_definition(spark):
    rng = np.random.default_rng(0)
    n, fill = 40, 5.0
    labels = rng.integers(0, 5, n)
    d = np.triu(rng.random((n, n)), 1)
    d = d + d.T
    keep = rng.random((n, n)) < 0.3
    keep = (keep | keep.T) & ~np.eye(n, dtype=bool)
    dense = np.where(keep, d, fill)
    np.fill_diagonal(dense, 0)
    edges = spark.createDataFrame([(int(i), int(j), float(d[i, j])) for i, j in zip(*np.nonzero(keep), strict=True)], "i long, j long, d double")
    got = {r["roi_id"]: r["silhouette"] for r in quality.sample_silhouette(edges, spark.createDataFrame([(k, int(c)) for k, c in enumerate(labels)], "roi_id long, label int"), fill).collect()}
    for i in range(n):
        own = [j for j in range(n) if labels[j] == labels[i] and j != i]
        a = dense[i, own].mean() if own else 0
        b = min(dense[i, labels == c].mean() for c in set(labels) - {labels[i]})
        assert got[i] == pytest.approx((b - a) / max(a, b) if own else 0.0, abs=1e-9)


def test_alignment_takes_the_last_of_repeated_ids(spark):
    labels = spark.createDataFrame([(0, k, u) for k, u in enumerate([0, 1, 2])] + [(1, k, u) for k, u in enumerate([0, 1, 2, 3, 4, 5, 0, 1])], "session_id int, roi_idx long, ucid long")
    values = labels.select("session_id", "roi_idx", F.col("roi_idx").cast("double").alias("v"))
    got = rows(ids.align(labels, values), "session_id", "ucid", "v")
    assert [v for s, _, v in got if s == 0] == [0, 1, 2, None, None, None]
    assert [v for s, _, v in got if s == 1] == [6, 7, 2, 3, 4, 5]
    with pytest.raises(Exception, match="twice"):
        ids.invert(labels).collect()


def test_mask_by_label(spark):
    labels = spark.createDataFrame([(s, k, u) for s, us in enumerate([[1, 2, 3], [2, -1, 4], [3, 0, 5]]) for k, u in enumerate(us)], "session_id int, roi_idx long, ucid long")
    assert [r[2] for r in rows(ids.mask_by_label(labels, [2, 3]), "session_id", "roi_idx", "ucid")] == [-1, 2, 3, 2, -1, -1, 3, -1, -1]


def test_blur_equals_dense_convolution(spark):
    rng = np.random.default_rng(3)
    image = np.where(rng.random((9, 11)) < 0.2, rng.random((9, 11)), 0)
    entries = [(0, 0, int(y * 11 + x), float(image[y, x])) for y, x in zip(*np.nonzero(image), strict=True)]
    got = spatial.blur(spark.createDataFrame(entries, "roi_id long, session_id int, pixel long, weight double"), 2, 9, 11)
    kernel = {(r["dy"], r["dx"]): r["k"] for r in spatial.blur_kernel(spark, 2).collect()}
    assert sum(kernel.values()) == pytest.approx(1.0)
    want = np.zeros_like(image)
    for (dy, dx), k in kernel.items():
        for y, x in zip(*np.nonzero(image), strict=True):
            if 0 <= y + dy < 9 and 0 <= x + dx < 11:
                want[y + dy, x + dx] += image[y, x] * k
    out = np.zeros_like(image)
    for r in got.collect():
        out[divmod(r["pixel"], 11)] = r["weight"]
    assert np.allclose(out, want)


def test_overlap_join_has_no_nested_loop(spark, sf_dir):
    from tessera.plans import registry

    for name in ("footprint_similarity", "weighted_jaccard", "cluster_quality"):
        plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_dense_edges_do_not_depend_on_the_block(spark, sf_dir):
    from tessera.sources import harness

    v = harness.latent(spark, sf_dir, "nn")
    a = similarity.dense_cosine(v, 0.4).select("i", "j", F.round("s", 9))
    b = similarity.dense_cosine(v, 0.4, block=90).select("i", "j", F.round("s", 9))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_noise_rescue_and_sequential_assignment(spark):
    e = [(0, 1, 0.1), (2, 3, 0.1), (4, 0, 0.2), (5, 2, 0.25), (6, 0, 0.3), (7, 3, 0.35)]
    edges = spark.createDataFrame(e + [(j, i, d) for i, j, d in e], "i long, j long, d double")
    labels = spark.createDataFrame(list(zip(range(8), [0, 1, 0, 1, 2, 2, 1, 0], [0, 0, 1, 1, -1, -1, -1, -1], strict=True)), "roi_id long, session_id int, label long")
    assert [r[1] for r in rows(graph.noise_rescue(edges, labels, 0.5), "roi_id", "label")] == [0, 0, 1, 1, 0, 1, -1, -1]
    got, scores = graph.sequential_assignment(edges, labels.select("roi_id", "session_id"))
    tracks: dict[int, list[int]] = {}
    for r, label in rows(got, "roi_id", "label"):
        tracks.setdefault(label, []).append(r)
    assert sorted(m for t, m in tracks.items() if t >= 0) == [[0, 1, 4], [2, 3, 5]] or all(len(m) > 1 for t, m in tracks.items() if t >= 0)
    assert len(scores) == 2


def test_both_ways_to_components(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, 100 + k) for k in range(1, 20)] + [(50, 50)]
    nodes = spark.createDataFrame([(k,) for k in [*range(31), 40, 50, *range(100, 120)]], "roi_id long")
    edges = spark.createDataFrame(links, "i long, j long").repartition(3)
    want = sorted([(k, 0) for k in range(31)] + [(40, 40), (50, 50)] + [(k, 100) for k in range(100, 120)])
    assert rows(graph.connected_components(nodes, edges), "roi_id", "component") == want
    assert rows(graph.min_label_components(nodes, edges), "roi_id", "component") == want


def test_clusters_of_a_graph_with_known_objects(spark):
    rng = np.random.RandomState(42)
    pairs = []
    for s in range(4):
        for t in range(4):
            for a in range(20):
                for b in range(max(0, a - 2), min(20, a + 3)):
                    i, j = s * 20 + a, t * 20 + b
                    if i < j:
                        sim = 0.1 + rng.rand() * 0.1 if s == t else 0.8 + rng.rand() * 0.15 if a == b else 0.1 + rng.rand() * 0.2
                        pairs += [(i, j, 1 - sim), (j, i, 1 - sim)]
    roi = spark.createDataFrame([(s * 20 + a, s) for s in range(4) for a in range(20)], "roi_id long, session_id int")
    edges = spark.createDataFrame(pairs, "i long, j long, d double")
    got = graph.cluster(edges, roi)
    assert filters.session_violations(got).isEmpty()
    sizes = [r["n"] for r in got.where("label >= 0").groupBy("label").agg(F.count("*").alias("n")).collect()]
    assert sizes and min(sizes) > 1
    empty = graph.cluster(edges.limit(0), roi)
    assert {r["label"] for r in empty.collect()} == {-1}


def test_archive_labels_listing_and_completeness(spark, tmp_path):
    t = spark.createDataFrame([(0, "a"), (1, "b")], "image_index long, label string")
    store = files.Archive(spark, f"file://{tmp_path}/archive")
    store.save({"labels": t}, {"k": 1})
    assert rows(store["labels"], "image_index", "label") == [(0, "a"), (1, "b")] and store.manifest()["params"] == {"k": 1}
    with pytest.raises(KeyError):
        store["nothing"]
    files.write_labels(t, f"file://{tmp_path}/labels")
    assert rows(files.read_labels(spark, f"file://{tmp_path}/labels"), "image_index", "label") == [(0, "a"), (1, "b")]
    for name in ("s10", "s9", "s1"):
        (tmp_path / "tree" / name).mkdir(parents=True)
        (tmp_path / "tree" / name / "stat.npy").write_bytes(name.encode())
    found = [r["path"].split("/")[-2] for r in files.find_paths(spark, f"file://{tmp_path}/tree", r"stat\.npy$").collect()]
    assert found == ["s1", "s9", "s10"]
    assert files.file_hashes(spark, f"file://{tmp_path}/tree").where("path LIKE '%s9/%'").first()["sha256"] == files.sha256_file(str(tmp_path / "tree/s9/stat.npy"))
    assert files.completeness({"roi_image": t, "session": t}) == {"classification_inference": True, "classification_training": False, "tracking": False}


def test_recordings_are_read_and_normalised(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"s{k}").mkdir()
        np.save(tmp_path / f"s{k}" / "stat.npy", np.array([{"ypix": [0, 1], "xpix": [2, 3], "lam": [1.0, 3.0 + k]}, {"ypix": [4], "xpix": [4], "lam": [2.0]}], dtype=object), allow_pickle=True)
    stat = files.read_stat(spark, [f"file://{tmp_path}/s{k}/stat.npy" for k in range(2)])
    got = rows(files.stat_to_footprint(stat, 10), "session_id", "roi_idx", "pixel", "weight")
    assert got == [(0, 0, 2, 0.25), (0, 0, 13, 0.75), (0, 1, 44, 1.0), (1, 0, 2, 0.2), (1, 0, 13, 0.8), (1, 1, 44, 1.0)]


def test_classifier_is_saved_checked_and_used(spark, sf_dir, tmp_path):
    from tessera.operators import classify

    rng = np.random.default_rng(0)
    data = [(k, [float(x) for x in rng.normal(c * 3, 1, 4)], c) for k, c in enumerate(rng.integers(0, 2, 120).tolist())]
    table = spark.createDataFrame(data, "roi_id long, vec array<double>, label int")
    model, trials = classify.autotune(table, [0, 1], (0.1, 1.0), max_iter=20)
    scored = classify.predict(model, table, [0, 1])
    assert len(trials) == 2 and scored.where("predicted = label").count() > 110
    manifest = classify.save(model, [0, 1], str(tmp_path / "model"))
    assert classify.save(model, [0, 1], str(tmp_path / "again")) == manifest
    loaded = classify.predict_saved(classify.load(str(tmp_path / "model")), table)
    assert loaded.join(scored.select("roi_id", F.col("predicted").alias("p")), "roi_id").where("p <> predicted").isEmpty()
    (tmp_path / "again" / "classes.json").write_text("[0, 2]")
    with pytest.raises(classify.IntegrityError):
        classify.load(str(tmp_path / "again"))


def test_stream_of_sessions_equals_the_batch_operator(spark, tmp_path):
    from tessera.streaming.incremental import Tracker

    tracker = Tracker(spark, f"file://{tmp_path}/state")
    first = spark.createDataFrame([(0, None, None), (1, None, None)], "i long, j long, d double")
    second = spark.createDataFrame([(2, 0, 0.2), (3, 0, 0.1), (3, 1, 0.9)], "i long, j long, d double")
    tracker.advance(first, 0)
    tracker.advance(second, 1)
    tracker.advance(second, 1)
    assert rows(tracker.union(1), "track", "roi_id") == [(0, 2), (1, 3)]
