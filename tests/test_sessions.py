"""Registration, class filters, clustering by-products, label matching, packages, archives, reports."""

from __future__ import annotations

import itertools
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.compare import staged_report
from tessera.operators import classify, filters, graph, package, quality, registration
from tessera.plans import graphs, registry
from tessera.sources import files, memory
from tessera.sources import harness as H


def test_points_give_their_warp_back(spark):
    rng = np.random.default_rng(1)
    points = rng.uniform(0, 100, (40, 2))
    moved = points @ np.array([[0.8, -0.6], [0.6, 0.8]]).T + [3.0, -5.0]
    moved[:8] += rng.uniform(20, 50, (8, 2))
    rows = [(0, 1, *map(float, p), *map(float, q)) for p, q in zip(points, moved, strict=True)] + [(0, 2, 1.0, 2.0, 3.0, 4.0), (0, 1, None, 1.0, 1.0, 1.0)]
    found = {r["b"]: r for r in registration.fit_points(spark.createDataFrame(rows, "a int, b int, x double, y double, u double, v double")).collect()}
    assert found[1]["n_points"] == 40 and found[1]["n_inside"] == 32
    assert np.allclose(found[1]["m"], [0.8, -0.6, 3, 0.6, 0.8, -5, 0, 0, 1], atol=1e-6)
    assert tuple(found[2]["m"]) == registration.IDENTITY and found[2]["n_inside"] == 0
    assert registration.fit_points(spark.createDataFrame([], "a int, b int, x double, y double, u double, v double")).isEmpty()


def test_templates():
    assert [registration.template_place(t, 5) for t in (0.5, 1.0, 0.0, 3)] == [2, 4, 0, 3]
    for wrong in (5, -1, 1.5):
        with pytest.raises(ValueError):
            registration.template_place(wrong, 5)


@pytest.mark.parametrize("method", ["sequential", "image"])
def test_shifted_sessions_are_registered(spark, method):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(32, 32))
    shifts = [(0, 0), (2, 1), (3, -2), (5, 0)]
    fov = spark.createDataFrame([(s, np.roll(base, at, (0, 1)).ravel().tolist()) for s, at in enumerate(shifts)] + [(4, rng.normal(size=32 * 32).tolist())], "session_id int, img array<double>")
    found = {r["session_id"]: r for r in registration.fit_geometric(fov, 32, 32, 1, method, z_threshold=6.0).collect()}
    for s, (dy, dx) in enumerate(shifts):
        assert found[s]["aligned"] and (found[s]["m"][5], found[s]["m"][2]) == (2 - dy, 1 - dx)
    assert not found[4]["aligned"] and found[1]["z_in"] is None


def test_tree_is_the_constrained_one(spark, sf_dir):
    edges = graphs.distances(spark, sf_dir).where("inter AND d < 0.62 AND i < j").toPandas()
    near = {}
    for r in edges.itertuples():
        near.setdefault(r.i, []).append(r.d)
        near.setdefault(r.j, []).append(r.d)
    core = {k: min(v) for k, v in near.items()}
    group, want = {k: {k} for k in core}, []
    for r, _, i, j in sorted((max(e.d, core[e.i], core[e.j]), e.d, e.i, e.j) for e in edges.itertuples()):
        if group[i] is not group[j] and not {x % 8 for x in group[i]} & {x % 8 for x in group[j]}:
            both = group[i] | group[j]
            for x in both:
                group[x] = both
            want.append((round(r, 6), i, j))
    got = registry.queries()["spanning_tree"](spark, sf_dir).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(len(want)))
    assert [(r["d"], r["i"], r["j"]) for r in got] == [(pytest.approx(d), i, j) for d, i, j in want]


def test_fit_resolves_its_distances(spark, sf_dir):
    rows = registry.queries()["clustering_default"](spark, sf_dir)
    sizes = rows.where("label >= 0").groupBy("label").count().toPandas()
    assert sizes["count"].min() >= 2 and sorted(sizes["label"]) == list(range(len(sizes)))
    assert filters.session_violations(rows).isEmpty() and rows.count() == H.roi(spark, sf_dir).count()
    roi = spark.createDataFrame([(s * 3 + k, s) for s in range(4) for k in range(3)], "roi_id long, session_id int")
    d = [(a * 3 + k, b * 3 + k, 0.1 + 0.01 * k) for k in range(3) for a in range(4) for b in range(a) if not (k == 2 and 3 in (a, b))]
    edges = spark.createDataFrame(d, "i long, j long, d double")
    assert {r["label"]: r["count"] for r in graph.fit(edges, roi, 0.5, "all").groupBy("label").count().collect()} == {0: 4, 1: 4, -1: 4}
    assert {r["label"] for r in graph.fit(edges.limit(0), roi).collect()} == {-1}
    with pytest.raises(ValueError):
        graph.fit(edges, roi, 0.5, "some")


def brute_match(truth, test, ignore):
    names, others = sorted(set(truth)), sorted(set(test))
    others += [None] * max(0, len(names) - len(others))
    size = np.array([0 if ignore and k == -1 else sum(t == k for t in truth) for k in names], float)
    share = np.array([[0.0 if s == 0 or (ignore and o == -1) else sum(t == k and u == o for t, u in zip(truth, test, strict=True)) / s for o in others] for k, s in zip(names, size, strict=True)])
    best = max(itertools.permutations(range(len(others)), len(names)), key=lambda p: sum(share[r, c] for r, c in enumerate(p)))
    return sum(share[r, c] for r, c in enumerate(best)), share, size


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("ignore", [False, True])
def test_matching_is_the_best(seed, ignore):
    rng = np.random.default_rng(seed)
    truth = rng.integers(-1, 4, 30)
    test = np.where(rng.random(30) < 0.3, rng.integers(-1, 5, 30), truth)
    cells = {}
    for a, b in zip(truth, test, strict=True):
        cells[a, b] = cells.get((a, b), 0) + 1
    got = quality.match_scores(*(np.array(c) for c in zip(*[(a, b, n) for (a, b), n in cells.items()], strict=True)), ignore)
    total, share, _ = brute_match(truth.tolist(), test.tolist(), ignore)
    assert got["match_unweighted_partial"] == pytest.approx(total / len(share))
    assert 0 <= got["match_weighted_perfect"] <= got["match_weighted_partial"] <= 1


def test_unassigned_objects_are_clusters_of_their_own():
    a, b = np.array([0, 0, 0, -1, -1, 1, 1, 2]), np.array([0, 0, -1, 0, -1, 1, 1, -1])
    apart = lambda x, first: np.where(x == -1, np.arange(first, first + len(x)), x)
    table = lambda x, y: np.array([[np.sum((x == p) & (y == q)) for q in np.unique(y)] for p in np.unique(x)], float)
    cells = [(p, q, int(np.sum((a == p) & (b == q)))) for p in np.unique(a) for q in np.unique(b)]
    got = quality.cell_information(*(np.array(c) for c in zip(*[c for c in cells if c[2]], strict=True)))
    assert got == pytest.approx(quality.adjusted_mutual_information(table(apart(a, 100), apart(b, 200))))
    assert quality._log_factorial(np.array([0, 5, 255, 256, 1000])) == pytest.approx([0.0, np.log(120), sum(np.log(np.arange(1, 256))), sum(np.log(np.arange(1, 257))), sum(np.log(np.arange(1, 1001)))], rel=1e-13)


def test_scores_of_labels_are_whole(spark):
    rows = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, -1)], "truth long, test long")
    found = quality.score_labels(rows)
    assert found["match_weighted_partial"] == pytest.approx(0.75) and found["match_unweighted_perfect"] == 0.5 and 0 < found["accuracy_norm"] < 1
    with pytest.raises(ValueError, match="cells"):
        quality.score_labels(rows, most_cells=1)


def test_class_filter_wants_one_list(spark):
    roi = spark.createDataFrame([(0, 0, 0), (1, 0, 1), (2, 1, 0)], "roi_id long, session_id int, roi_idx long")
    labels = spark.createDataFrame([(0, 5), (1, 7), (2, None)], "roi_id long, label int")
    left = filters.keep_classes({"roi": roi, "session": roi.select("session_id").distinct()}, labels, keep=[7])
    assert left["roi"].collect() == [(0, 0, 0)] and left["labels"].collect() == [(0, 7, 0)] and left["session"].count() == 2
    with pytest.raises(ValueError):
        filters.keep_classes({"roi": roi}, labels, [5], [7])


def test_log_search_finds_the_valley():
    seen = classify.log_search(lambda c: (np.log10(c) - 1.3) ** 2, 1e-5, 1e3, most=30, patience=8)
    assert min(seen, key=lambda t: t[1])[0] == pytest.approx(10**1.3, rel=0.1) and len(seen) <= 30
    assert len(classify.log_search(lambda c: 1.0, 1e-2, 1e2, patience=3)) == 8
    with pytest.raises(ValueError):
        classify.log_search(lambda c: c, 1.0, 1.0)


def test_package_is_one_file_and_replays_its_preparation(spark, tmp_path):
    rng = np.random.default_rng(0)
    stack = rng.random((40, 8, 8)) + np.where(np.arange(40) % 2, 1, 0)[:, None, None] * np.eye(8) * 3
    images = spark.createDataFrame([(k, v.ravel().tolist()) for k, v in enumerate(stack)], "roi_id long, img array<double>").repartition(3)
    vectors = package.embed(images, 1.5, 8, 8, angles=3).withColumn("label", (F.col("roi_id") % 2).cast("int"))
    model, _ = classify.autotune(vectors, [0, 1], (1.0,), max_iter=20)
    built = package.build(model, [0, 1], ["noise", "cell"], 8, 8, angles=3)
    path = package.save(built, str(tmp_path / "one"))
    assert path.endswith(package.SUFFIX) and package.to_bytes(built) == open(path, "rb").read()
    with pytest.raises(FileExistsError):
        package.save(built, path)
    loaded = package.load(path)
    got = package.predict(loaded, images, 1.5).orderBy("roi_id").collect()
    assert [r["name"] for r in got] == [["noise", "cell"][k % 2] for k in range(40)]
    assert package.predict(loaded, images.repartition(7), 1.5).orderBy("roi_id").collect() == got
    assert package.predict(loaded, images.limit(0), 1.5).isEmpty()
    with pytest.raises(Exception, match="8 x 8"):
        package.predict(loaded, images.select("roi_id", F.slice("img", 1, 9).alias("img")), 1.5).collect()
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    for name, content in (("classifier.json", b"{}"), ("embedding.json", None), ("metadata.json", b'{"schema_version": 0}')):
        with zipfile.ZipFile(tmp_path / "bad", "w") as z:
            for n, c in parts.items():
                if n != name:
                    z.writestr(n, c)
                elif content is not None:
                    z.writestr(n, content)
        with pytest.raises(classify.IntegrityError):
            package.load(str(tmp_path / "bad"))
    with pytest.raises(classify.IntegrityError, match="name"):
        package.build(model, [0, 1], ["a", "a"], 8, 8, angles=3)
    with pytest.raises(classify.IntegrityError, match="embedding"):
        package.build(model, [0, 1], ["a", "b"], 16, 8, angles=3)


def test_archive_in_one_file(spark, tmp_path):
    archive = files.Archive(spark, f"file://{tmp_path}/a")
    archive.save({"t": spark.range(5).repartition(2)}, {"k": [1, 2]})
    assert archive.export(str(tmp_path / "a.zip")) >= 3
    again = files.Archive.imported(spark, str(tmp_path / "a.zip"), f"file://{tmp_path}/b")
    assert sorted(r[0] for r in again["t"].collect()) == [0, 1, 2, 3, 4] and again.manifest()["params"] == {"k": [1, 2]}
    with pytest.raises(FileExistsError):
        files.Archive.imported(spark, str(tmp_path / "a.zip"), f"file://{tmp_path}/b")
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../x", b"")
    with pytest.raises(ValueError, match="outside"):
        files.Archive.imported(spark, str(tmp_path / "bad.zip"), f"file://{tmp_path}/c")


def test_yaml(tmp_path):
    pytest.importorskip("yaml")
    memory.save_yaml({"b": [1, 2], "a": None}, str(tmp_path / "p.yaml"))
    assert memory.load_yaml(str(tmp_path / "p.yaml")) == {"b": [1, 2], "a": None}


def test_staged_report():
    found = staged_report({"a": [1.0], "b": [2.0], "d": 1}, {"a": [1.0 + 1e-5], "b": [2.1], "c": 0, "d": 1}, {"a": 1e-3})
    assert [(s, ok) for s, ok, _ in found] == [("a", True), ("b", False), ("c", False), ("d", True)]
