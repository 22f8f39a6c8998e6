"""Pairs are found without shuffling or storing them, and are the same as by the plain way."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import calibrate, filters, similarity, spatial
from tessera.plans import graphs, registry


def plan(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_blocks_are_listed_once_without_a_shuffle_of_pairs(spark, sf_dir):
    rng = np.random.default_rng(2)
    blocks = {k: {int(b) for b in rng.choice(9, int(rng.integers(1, 4)), replace=False)} for k in range(120)}
    members = spark.createDataFrame([(k, b) for k, own in blocks.items() for b in own] + [(3, b) for b in blocks[3]], "roi_id long, block_id long")
    want = sorted((i, j) for i, j in itertools.combinations(blocks, 2) if blocks[i] & blocks[j])
    for chunk in (1000, 3):
        assert sorted(map(tuple, spatial.block_candidates(members, chunk).collect())) == want
    shape = plan(registry.queries()["block_candidates"](spark, sf_dir))
    assert "Aggregate" not in shape and "Join" not in shape
    assert spatial.block_candidates(members.limit(0)).isEmpty()


def test_a_metric_of_two_parts_never_sees_a_whole_block(spark):
    rows = spark.createDataFrame([(k, k % 2 if k else None, float(k * k % 31)) for k in range(121)], "roi_id long, block_id int, v double")

    def near(left, right):
        assert max(len(left), len(right)) <= 40
        own, other = left["roi_id"].to_numpy()[:, None], right["roi_id"].to_numpy()[None, :]
        a, b = np.nonzero(own < other if left is right else own != other)
        i, j = left["roi_id"].to_numpy()[a], right["roi_id"].to_numpy()[b]
        return pd.DataFrame({"i": np.minimum(i, j), "j": np.maximum(i, j), "s": np.abs(left["v"].to_numpy()[a] - right["v"].to_numpy()[b])})

    want = sorted((i, j, abs(float(i * i % 31) - float(j * j % 31))) for i, j in itertools.combinations(range(1, 121), 2) if i % 2 == j % 2)
    assert sorted(map(tuple, similarity.custom_metric(rows, near, part=15).collect())) == want
    twice = rows.unionByName(rows.where("roi_id > 0").withColumn("block_id", F.col("block_id") + 2))
    assert sorted(map(tuple, similarity.custom_metric(twice, near, part=15).collect())) == want


def vectors(spark, n=90, copies=()):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, 6)) + 0.5
    rows = [(k, k % 3, [float(v) for v in x[k, :3]], [float(v) for v in x[k, 3:]]) for k in range(n)]
    rows[7] = (7, 1, [0.0] * 3, rows[7][3])
    rows[9] = (9, 0, rows[8][2], rows[8][3])
    return spark.createDataFrame(rows + [rows[k] for k in copies], "roi_id long, session_id int, a array<float>, b array<float>")


def test_both_metrics_of_an_edge_come_from_where_the_blocks_meet(spark, sf_dir):
    for copies in ((), (4, 5)):
        v = vectors(spark, copies=copies)
        e = similarity.dense_cosine(v.select("roi_id", F.col("a").alias("vec")), 0.3).withColumnRenamed("s", "a")
        e = similarity.inter_session(similarity.masked_cosine(e, v.select("roi_id", F.col("b").alias("vec")), "b"), v)
        r = [F.round("a", 9).alias("a"), F.round("b", 9).alias("b"), "inter"]
        want, got = e.select("i", "j", *r), similarity.dense_graph(v, ["a", "b"], 0.3, 17).select("i", "j", *r)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and not got.isEmpty()
    shape = plan(graphs.distances(spark, sf_dir))
    assert "Join" not in shape and "Scan ExistingRDD" not in shape


def test_second_order_similarity_from_vectors_equals_the_join(spark):
    for copies in ((), (4,)):
        v = vectors(spark, copies=copies).select("roi_id", F.col("a").alias("vec"))
        e = similarity.dense_cosine(v, 0.3)
        want = e.where("i < j").join(similarity.weighted_jaccard(e), ["i", "j"]).select("i", "j", F.round("s", 9), F.round("jaccard", 9))
        for block, span in ((4000, 4), (11, 2)):
            got = similarity.dense_jaccard(v, 0.3, block, span).select("i", "j", F.round("s", 9), F.round("jaccard", 9))
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Join" not in plan(similarity.dense_jaccard(vectors(spark).select("roi_id", F.col("a").alias("vec")), 0.3)).replace("BroadcastNestedLoopJoin", "")


def test_metrics_are_calibrated_together_as_alone(spark, sf_dir):
    g = graphs.graph(spark, sf_dir).cache()
    both = calibrate.calibrate_features(g, ["s_nn", "s_swt"], 20, 3)
    assert both == {c: calibrate.calibrate_feature(g, c, 20, 3) for c in both}
    low, high = g.agg(F.min("s_nn"), F.max("s_nn")).first()
    want = np.histogram([r[0] for r in g.select("s_nn").collect()], 20, (low - 1e-6, high + 1e-6))[0]
    assert [r["n_all"] for r in both["s_nn"]] == want.tolist()
    g.unpersist()


def test_a_sample_keeps_and_ranks_only_ranges_that_reach_it(spark, monkeypatch):
    seen = []
    placed = filters.placed_in_strata
    monkeypatch.setattr(filters, "placed_in_strata", lambda rows, *a: seen.append(rows.count()) or placed(rows, *a))
    rows = [(k, 0, None if k % 50 == 0 else k % 10 == 0) for k in range(20_000)]
    got = filters.stratified_sample(spark.createDataFrame(rows, "i long, j long, inter boolean"), "inter", 500, ("i", "j"), 30)
    want = []
    for s in (True, False):
        own = sorted((k * 7919 % 1_000_003, k) for k, _, x in rows if x is s)
        want += [k for _, k in own[: max(len(own) * 500 // 20_000, 30)]]
    assert sorted(r["i"] for r in got.collect()) == sorted(want) and seen[0] < 1000


def test_small_components_share_a_call_and_keep_their_clusters(spark, monkeypatch):
    from tessera.operators import graph

    rng = np.random.default_rng(8)
    roi = spark.createDataFrame([(k, k % 4) for k in range(160)], "roi_id long, session_id int")
    near = [(k, k + int(rng.integers(1, 4)), float(rng.random())) for k in range(0, 156) if k % 9 < 6]
    edges = spark.createDataFrame(near, "i long, j long, d double")
    got = {}
    for together in (graph.TOGETHER, 0):
        monkeypatch.setattr(graph, "TOGETHER", together)
        got[together] = sorted(map(tuple, graph.cluster(edges, roi, rescue_cutoff=0.6).collect()))
    first, second = got.values()
    assert first == second and len(first) == 160
    nodes = roi.select("roi_id")
    calls = graph._per_component(nodes, edges, lambda a, b: pd.DataFrame({"n": [len(a)]}), "n long", 2000).collect()
    assert sum(r["n"] for r in calls) == 160 and len(calls) <= 8
