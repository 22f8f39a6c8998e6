"""Queries over the similarity graph: edges, calibration, pruning, clustering, quality, classification."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import calibrate as C
from tessera.operators import graph as G
from tessera.operators import quality as U
from tessera.operators import similarity as M
from tessera.operators.checkpoints import cut
from tessera.plans import sql as Q
from tessera.plans.registry import register
from tessera.sources import harness as H

LEAST = 0.35
BINS, WINDOW = 20, 3


def edges(spark, d):
    return M.dense_cosine(H.vectors(spark, d).select("roi_id", F.col("s_nn").alias("vec")), LEAST)


def graph(spark, d):
    """``i, j, s_nn, s_swt, inter``: both metrics on the first one's edges."""
    return M.dense_graph(H.vectors(spark, d), ["s_nn", "s_swt"], LEAST)


_E = Q.with_(Q.NN, Q.EDGES)
_SWT_S = "greatest(list_cosine_similarity(x.vec, y.vec), 0)"
_GRAPH = f"graph AS (SELECT i, j, s AS s_nn, CASE WHEN {_SWT_S} > 1 - 1e-5 THEN 1.0 ELSE {_SWT_S} END AS s_swt, i % 8 <> j % 8 AS inter FROM edges JOIN swt x ON x.roi_id = i JOIN swt y ON y.roi_id = j)"
_G = Q.with_(Q.NN, Q.SWT, Q.EDGES, _GRAPH)
_D = "dist AS (SELECT i, j, inter, 1 - (s_nn + s_swt) / 2 AS d FROM graph)"


def distances(spark, d):
    """``i, j, inter, d``: one minus the mean of both metrics."""
    return graph(spark, d).select("i", "j", "inter", (F.lit(1.0) - (F.col("s_nn") + F.col("s_swt")) / 2).alias("d"))


@register("cluster_quality", Q.with_(Q.NN, Q.EDGES, Q.ROI) + """, e AS (SELECT a.label AS li, b.label AS lj, s FROM edges JOIN roi a ON a.roi_id = i JOIN roi b ON b.roi_id = j),
n AS (SELECT label, count(*) AS n FROM roi GROUP BY 1),
q AS (SELECT n.label, n.n, coalesce(sum(s) FILTER (li = lj), 0) / (n.n * (n.n - 1)) AS m, count(s) FILTER (li = lj) AS c, min(s) FILTER (li = lj) AS low, coalesce(max(s) FILTER (li = lj), 0) AS high, coalesce(max(s) FILTER (li <> lj), 0) AS o
  FROM n LEFT JOIN e ON li = n.label GROUP BY n.label, n.n)
SELECT label, n, round(m, 6) AS intra_mean, CASE WHEN c < n * (n - 1) THEN 0 ELSE round(low, 6) END AS intra_min, round(high, 6) AS intra_max, round((m - o) / greatest(m, o), 6) AS silhouette FROM q""")
def cluster_quality(spark, d):
    q = U.cluster_quality(edges(spark, d), H.roi(spark, d))
    return q.select("label", "n", *(F.round(c, 6).alias(c) for c in ("intra_mean", "intra_min", "intra_max", "silhouette")))


@register("cosine_edges", _E + "SELECT i, j, round(s, 6) AS s FROM edges")
def cosine_edges(spark, d):
    return edges(spark, d).select("i", "j", F.round("s", 6).alias("s"))


@register("masked_cosine", _G + "SELECT i, j, round(s_swt, 6) + 0.0 AS s FROM graph")
def masked_cosine(spark, d):
    return graph(spark, d).select("i", "j", (F.round("s_swt", 6) + 0.0).alias("s"))


@register("inter_session_flag", _E + "SELECT i, j, i % 8 <> j % 8 AS inter FROM edges")
def inter_session_flag(spark, d):
    return M.inter_session(edges(spark, d), H.roi(spark, d)).select("i", "j", "inter")


@register("precomputed_metric", _E + "SELECT i, j, CASE WHEN i < j AND s > 0.5 THEN round(s, 6) ELSE 0 END AS s_own FROM edges")
def precomputed_metric(spark, d):
    e = edges(spark, d)
    return M.precomputed(e, e.where("i < j AND s > 0.5"), "s_own").select("i", "j", F.round("s_own", 6).alias("s_own"))


@register("custom_metric", Q.with_(Q.ROI) + "SELECT a.roi_id AS i, b.roi_id AS j, round(1.0 / (1 + abs(a.cy - b.cy) + abs(a.cx - b.cx)), 6) AS s FROM roi a JOIN roi b ON a.session_id = b.session_id AND a.roi_id < b.roi_id")
def custom_metric(spark, d):
    def nearness(left, right):
        own, other = left["roi_id"].to_numpy()[:, None], right["roi_id"].to_numpy()[None, :]
        a, b = np.nonzero(own < other if left is right else own != other)
        i, j = left["roi_id"].to_numpy()[a], right["roi_id"].to_numpy()[b]
        away = sum(np.abs(left[c].to_numpy()[a] - right[c].to_numpy()[b]) for c in ("cy", "cx"))
        return pd.DataFrame({"i": np.minimum(i, j), "j": np.maximum(i, j), "s": 1.0 / (1 + away)})

    return M.custom_metric(H.roi(spark, d), nearness, "session_id", 1000).select("i", "j", F.round("s", 6).alias("s"))


_DONUT = "donut AS (SELECT a.roi_id AS i, b.roi_id AS j, row_number() OVER (PARTITION BY a.roi_id ORDER BY pow(a.cy - b.cy, 2) + pow(a.cx - b.cx, 2), b.roi_id)::INTEGER AS rank FROM roi a, roi b QUALIFY rank > 20 AND rank <= 60)"


@register("knn_donut", Q.with_(Q.ROI, _DONUT) + "SELECT * FROM donut")
def knn_donut(spark, d):
    return M.knn_donut(H.roi(spark, d), 20, 60)


@register("donut_cosine", Q.with_(Q.ROI, Q.NN, _DONUT) + "SELECT i, j, round(list_cosine_similarity(a.vec, b.vec), 6) + 0.0 AS s FROM donut JOIN nn a ON a.roi_id = i JOIN nn b ON b.roi_id = j")
def donut_cosine(spark, d):
    return M.gather_dot(M.knn_donut(H.roi(spark, d), 20, 60), H.latent(spark, d, "nn")).select("i", "j", (F.round("s", 6) + 0.0).alias("s"))


@register("zscore_similarity", Q.with_(Q.ROI, Q.NN, Q.EDGES, _DONUT) + ", st AS (SELECT i, avg(list_cosine_similarity(a.vec, b.vec)) AS mu, stddev_samp(list_cosine_similarity(a.vec, b.vec)) AS sd FROM donut JOIN nn a ON a.roi_id = i JOIN nn b ON b.roi_id = j GROUP BY i) SELECT i, j, round((s - mu) / sd, 5) AS z FROM edges JOIN st USING (i)")
def zscore_similarity(spark, d):
    stats = M.donut_stats(M.knn_donut(H.roi(spark, d), 20, 60), H.latent(spark, d, "nn"))
    return M.zscore(edges(spark, d), stats).select("i", "j", F.round("z", 5).alias("z"))


@register("weighted_jaccard", _E + """, pairs AS (SELECT i, j FROM edges WHERE i < j),
t AS (SELECT p.i, p.j, sum(least(coalesce(a.s, 0), coalesce(b.s, 0))) AS lo, sum(greatest(coalesce(a.s, 0), coalesce(b.s, 0))) AS hi
  FROM pairs p JOIN (SELECT DISTINCT p.i, p.j, e.j AS k FROM pairs p JOIN edges e ON e.i IN (p.i, p.j)) k ON k.i = p.i AND k.j = p.j AND k.k NOT IN (p.i, p.j)
  LEFT JOIN edges a ON a.i = p.i AND a.j = k.k LEFT JOIN edges b ON b.i = p.j AND b.j = k.k GROUP BY ALL)
SELECT i, j, round(coalesce(lo / nullif(hi, 0), 0), 6) AS jaccard FROM pairs LEFT JOIN t USING (i, j)""")
def weighted_jaccard(spark, d):
    return M.dense_jaccard(H.vectors(spark, d).select("roi_id", F.col("s_nn").alias("vec")), LEAST).select("i", "j", F.round("jaccard", 6).alias("jaccard"))


_BINS = f"""dense AS (SELECT inter, CASE WHEN d >= 1 THEN {BINS - 1} ELSE floor(d * {BINS}) END::INTEGER AS bin FROM dist WHERE d BETWEEN 0 AND 1),
b0 AS (SELECT k::INTEGER AS bin, coalesce(n_all, 0) AS n_all, coalesce(n_intra, 0) AS n_intra FROM range({BINS}) t(k) LEFT JOIN (SELECT bin, count(*) AS n_all, count(*) FILTER (NOT inter) AS n_intra FROM dense GROUP BY 1) ON bin = k),
b1 AS (SELECT *, n_intra * (SELECT sum(n_all) / sum(n_intra) FROM b0) AS diff FROM b0),
b2 AS (SELECT *, greatest(n_all - diff, 0) AS same FROM b1),
bins AS (SELECT *, avg(diff) OVER w AS diff_smooth, avg(same) OVER w AS same_smooth FROM b2 WINDOW w AS (ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""
_B = Q.with_(Q.NN, Q.SWT, Q.EDGES, _GRAPH, _D, _BINS)


@register("calibration_hist", _B + "SELECT bin, n_all, n_intra, round(diff, 6) AS diff, round(same, 6) AS same, round(same / (same + diff_smooth + 1e-10), 6) AS p_same FROM bins")
def calibration_hist(spark, d):
    b = C.p_same(C.same_diff_bins(distances(spark, d), "d", BINS, WINDOW, 0.0, 1.0))
    return b.select("bin", "n_all", "n_intra", F.round("diff", 6).alias("diff"), F.round("same", 6).alias("same"), F.round("p_same", 6).alias("p_same"))


_PEAK = "peak AS (SELECT bin AS peak FROM bins ORDER BY diff DESC, bin LIMIT 1), cross_ AS (SELECT max(bin) AS k FROM bins, peak WHERE bin < peak AND diff < same_smooth)"


@register("crossover", _B.rstrip() + ", " + _PEAK + f" SELECT round((k + 1) / {BINS}.0, 6) AS d_crossover FROM cross_")
def crossover(spark, d):
    return C.crossover(distances(spark, d), BINS, WINDOW).select(F.round("d_crossover", 6).alias("d_crossover"))


@register("hist_overlap", _B.rstrip() + ", " + _PEAK + " SELECT round(CASE WHEN k IS NULL THEN 1e6 ELSE (SELECT sum(same_smooth * diff) FROM bins) END, 4) AS overlap FROM cross_")
def hist_overlap(spark, d):
    return C.crossover(distances(spark, d), BINS, WINDOW).select(F.round("overlap", 4).alias("overlap"))


@register("prune_by_distance", _G.rstrip() + ", " + _D + " SELECT i, j, round(d, 6) AS d FROM dist WHERE d < 0.6")
def prune_by_distance(spark, d):
    return C.prune(distances(spark, d), d_cutoff=0.6).select("i", "j", F.round("d", 6).alias("d"))


@register("monotone_probability", _B.rstrip() + f""", sm AS (SELECT bin, coalesce(same_smooth / nullif(same_smooth + diff_smooth, 0), 0) AS raw FROM bins)
SELECT bin, round(bin / {BINS}.0, 6) AS x, round(max(raw) OVER (ORDER BY bin DESC), 6) AS p FROM sm UNION ALL SELECT {BINS}, 1.0, 0.0""")
def monotone_probability(spark, d):
    b = C.same_diff_bins(distances(spark, d), "d", BINS, WINDOW, 0.0, 1.0)
    return C.monotone_probability(b, BINS, WINDOW).select("bin", F.round("x", 6).alias("x"), F.round("p", 6).alias("p"))


@register("fisher_sigmoid", _B.rstrip() + f""", mid AS (SELECT (bin + 0.5) / {BINS} AS c, same / ((SELECT sum(same) FROM bins) + 1e-10) AS ws, diff_smooth / ((SELECT sum(diff_smooth) FROM bins) + 1e-10) AS wd FROM bins),
grid AS (SELECT m * 30 + b AS g, 0.5 / {BINS} + m * (1 - 1.0 / {BINS}) / 49 AS mu, 0.5 + b * 9.5 / 29 AS b FROM range(50) x(m), range(30) y(b)),
v AS (SELECT g, mu, b, ws, wd, 1 / (1 + exp(-b * (c - mu))) AS v FROM grid, mid),
m AS (SELECT *, sum(ws * v) OVER (PARTITION BY g) AS ms, sum(wd * v) OVER (PARTITION BY g) AS md FROM v),
f AS (SELECT g, mu, b, pow(any_value(ms) - any_value(md), 2) / (sum(ws * pow(v - ms, 2)) + sum(wd * pow(v - md, 2)) + 1e-12) AS fisher FROM m GROUP BY ALL)
SELECT round(mu, 6) AS mu, round(b, 6) AS b, round(fisher, 5) AS fisher FROM f ORDER BY round(f.fisher, 9) DESC, g LIMIT 1""")
def fisher_sigmoid(spark, d):
    b = C.same_diff_bins(distances(spark, d), "d", BINS, WINDOW, 0.0, 1.0)
    return C.fisher_sigmoid(b, BINS).select(F.round("mu", 6).alias("mu"), F.round("b", 6).alias("b"), F.round("fisher", 5).alias("fisher"))


_TABLE = [{"bin": k, "low": 0.0, "high": 1.0, "same": 1.0 + k, "diff_smooth": 3.0, "p": 0.05 + 0.9 * k / (BINS - 1)} for k in range(BINS)]
_PRIOR = sum(r["same"] for r in _TABLE) / sum(r["same"] + r["diff_smooth"] for r in _TABLE)


@register("naive_bayes_combine", _G + f"""SELECT i, j, round(1 / (1 + exp(-(ln(p1 / (1 - p1)) + ln(p2 / (1 - p2)) - ln({_PRIOR!r} / (1 - {_PRIOR!r}))))), 6) AS p_same FROM (
  SELECT i, j, 0.05 + 0.9 * least(greatest(ceil(s_nn * {BINS}) - 1, 0), {BINS - 1}) / {BINS - 1} AS p1, 0.05 + 0.9 * least(greatest(ceil(s_swt * {BINS}) - 1, 0), {BINS - 1}) / {BINS - 1} AS p2 FROM graph)""")
def naive_bayes_combine(spark, d):
    """A fixed table for both metrics; fitted ones are in ``isotonic_calibration``."""
    return C.naive_bayes(graph(spark, d), {"s_nn": _TABLE, "s_swt": _TABLE}).select("i", "j", F.round("p_same", 6).alias("p_same"))


@register("conjunctive_distance", _G + "SELECT i, j, round(1 - CASE WHEN s_swt = 0 THEN 0 ELSE pow((pow(1 / (1 + exp(-8 * (s_nn - 0.4))), -1.5) + pow(pow(s_swt, 0.7), -1.5)) / 2, 1 / -1.5) END, 6) AS d FROM graph")
def conjunctive_distance(spark, d):
    e = C.conjunctive(graph(spark, d), {"s_nn": {"mu": 0.4, "b": 8.0}, "s_swt": {"power": 0.7}}, -1.5)
    return e.select("i", "j", F.round("d", 6).alias("d"))


@register("to_probability", _G.rstrip() + ", " + _D + " SELECT i, j, round(CASE WHEN d < 0.5 THEN 1 - d ELSE 0.5 - (d - 0.5) END, 6) AS sim FROM dist WHERE d BETWEEN 0 AND 1")
def to_probability(spark, d):
    return C.to_probability(distances(spark, d).where("d BETWEEN 0 AND 1"), [1.0, 0.5, 0.0]).select("i", "j", F.round("sim", 6).alias("sim"))


@register("cluster_pair_matrix", Q.with_(Q.NN, Q.EDGES, Q.ROI) + """, n AS (SELECT label, count(*) AS n FROM roi GROUP BY 1)
SELECT label_i, label_j, round(total / pairs, 6) AS s_mean, round(s_max, 6) AS s_max, CASE WHEN c < pairs THEN 0.0 ELSE round(low, 6) END AS s_min FROM (
  SELECT a.label AS label_i, b.label AS label_j, sum(s) AS total, max(s) AS s_max, min(s) AS low, count(*) AS c, any_value(x.n * (y.n - (a.label = b.label)::INTEGER)) AS pairs
  FROM edges JOIN roi a ON a.roi_id = i JOIN roi b ON b.roi_id = j JOIN n x ON x.label = a.label JOIN n y ON y.label = b.label GROUP BY a.label, b.label)""")
def cluster_pair_matrix(spark, d):
    return U.cluster_pair_matrix(edges(spark, d), H.roi(spark, d)).select("label_i", "label_j", *(F.round(c, 6).alias(c) for c in ("s_mean", "s_max", "s_min")))


@register("sample_silhouette", Q.with_(Q.NN, Q.EDGES, Q.ROI) + """, n AS (SELECT label, count(*) AS n FROM roi GROUP BY 1),
full_ AS (SELECT r.roi_id, r.label AS own, n.label AS other, coalesce(sum(1 - e.s), 0) AS total, count(e.s) AS c, any_value(n.n - (n.label = r.label)::INTEGER) AS m
  FROM roi r CROSS JOIN n LEFT JOIN (SELECT i, s, roi.label AS lj FROM edges JOIN roi ON roi.roi_id = j) e ON e.i = r.roi_id AND e.lj = n.label GROUP BY r.roi_id, r.label, n.label),
mean_ AS (SELECT *, (total + (m - c) * 2.0) / m AS v FROM full_),
ab AS (SELECT roi_id, own, max(v) FILTER (own = other) AS a, min(v) FILTER (own <> other) AS b FROM mean_ GROUP BY ALL)
SELECT roi_id, own AS label, round(a, 6) AS a, round(b, 6) AS b, round((b - a) / greatest(a, b), 6) + 0.0 AS silhouette FROM ab""")
def sample_silhouette(spark, d):
    s = U.sample_silhouette(edges(spark, d).select("i", "j", (F.lit(1.0) - F.col("s")).alias("d")), H.roi(spark, d), fill=2.0)
    return s.select("roi_id", "label", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), (F.round("silhouette", 6) + 0.0).alias("silhouette"))


def _judged(spark, d):
    """A labelling to score: the class against a coarse copy of it, with unassigned rows."""
    return H.roi(spark, d).select("roi_id", F.col("label").alias("truth"), F.when(F.col("roi_id") % 11 == 0, -1).when(F.col("roi_id") % 7 == 0, F.col("label") % 4).otherwise(F.col("label")).alias("test"))


_JUDGED = "judged AS (SELECT roi_id, label AS truth, CASE WHEN roi_id % 11 = 0 THEN -1 WHEN roi_id % 7 = 0 THEN label % 4 ELSE label END AS test FROM roi)"


@register("confusion_matrix", Q.with_(Q.ROI, _JUDGED, "l AS (SELECT DISTINCT unnest([truth, test]) AS l FROM judged)") + "SELECT p.l AS pred, t.l AS truth, round(coalesce(n::DOUBLE / nullif((SELECT count(*) FROM judged WHERE truth = t.l), 0), 0), 6) AS v FROM l p, l t LEFT JOIN (SELECT test, truth, count(*) AS n FROM judged GROUP BY ALL) c ON c.test = p.l AND c.truth = t.l")
def confusion_matrix(spark, d):
    return U.confusion(_judged(spark, d), "test", "truth").select("pred", "truth", F.round("v", 6).alias("v"))


@register("pair_confusion", Q.with_(Q.ROI, _JUDGED) + """SELECT tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn, tn::DOUBLE AS tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round((tp - (tp + fn) * (tp + fp) / (tp + fp + fn + tn)) / ((2 * tp + fp + fn) / 2 - (tp + fn) * (tp + fp) / (tp + fp + fn + tn)), 6) AS ari FROM (
  SELECT count(*) FILTER (t AND s) AS tp, count(*) FILTER (s AND NOT t) AS fp, count(*) FILTER (t AND NOT s) AS fn, count(*) FILTER (NOT t AND NOT s) AS tn FROM (
    SELECT a.truth = b.truth AND a.truth <> -1 AS t, a.test = b.test AND a.test <> -1 AS s FROM judged a JOIN judged b ON a.roi_id < b.roi_id))""")
def pair_confusion(spark, d):
    return U.pair_scores(_judged(spark, d)).select("tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "ari")))


@register("v_measure", Q.with_(Q.ROI, _JUDGED) + """, j AS (SELECT CASE WHEN truth = -1 THEN 1000 + roi_id ELSE truth END AS a, CASE WHEN test = -1 THEN 1000 + roi_id ELSE test END AS b FROM judged),
h AS (SELECT (SELECT sum(-p * ln(p)) FROM (SELECT count(*) / (SELECT count(*) FROM j)::DOUBLE AS p FROM j GROUP BY a)) AS ha, (SELECT sum(-p * ln(p)) FROM (SELECT count(*) / (SELECT count(*) FROM j)::DOUBLE AS p FROM j GROUP BY b)) AS hb,
  (SELECT sum(-p * ln(p)) FROM (SELECT count(*) / (SELECT count(*) FROM j)::DOUBLE AS p FROM j GROUP BY a, b)) AS hab)
SELECT round((ha + hb - hab) / ha, 6) AS homogeneity, round((ha + hb - hab) / hb, 6) AS completeness, round(2 * (ha + hb - hab) / (ha + hb), 6) AS v FROM h""")
def v_measure(spark, d):
    return U.v_measure(_judged(spark, d)).select(*(F.round(c, 6).alias(c) for c in ("homogeneity", "completeness", "v")))


@register("log_loss", "SELECT round(sum(-w * ln(greatest(p, 1e-15))) / sum(w), 6) AS log_loss, round(sum(w) FILTER (p > 0.5) / sum(w), 6) AS accuracy FROM (SELECT l_discount * 9 + 0.05 AS p, l_quantity AS w FROM lineitem)")
def log_loss(spark, d):
    rows = H.table(spark, d, "lineitem").select((F.col("l_discount") * 9 + 0.05).alias("p"), F.col("l_quantity").alias("w"), ((F.col("l_discount") * 9 + 0.05) > 0.5).alias("guess"), F.lit(True).alias("truth"))
    return U.log_loss(rows, "p", "w").crossJoin(U.weighted_accuracy(rows, "guess", "truth", "w")).select(F.round("log_loss", 6).alias("log_loss"), F.round("accuracy", 6).alias("accuracy"))


@register("info_nce", _E + "SELECT round(avg(-ln(pos / whole)), 6) AS loss FROM (SELECT i, sum(exp(s / 0.1)) AS whole, sum(exp(s / 0.1)) FILTER (i % 10 = j % 10) AS pos FROM edges GROUP BY i) WHERE pos IS NOT NULL")
def info_nce(spark, d):
    from tessera.operators.classify import info_nce as loss

    return loss(edges(spark, d).withColumn("positive", F.col("i") % 10 == F.col("j") % 10)).select(F.round("loss", 6).alias("loss"))


_NEAR = "near AS (SELECT i, j FROM dist WHERE d < 0.45), reach AS (SELECT roi_id AS node, roi_id AS seen FROM roi UNION SELECT node, near.j FROM reach JOIN near ON near.i = reach.seen)"


@register("connected_components", _G.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ", " + _D + ", " + Q.ROI + ", " + _NEAR + " SELECT node AS roi_id, min(seen) AS component FROM reach GROUP BY node")
def connected_components(spark, d):
    near = distances(spark, d).where("d < 0.45")
    return G.connected_components(H.roi(spark, d), near).select("roi_id", "component")


@register("attach_hub", _G.rstrip() + ", " + _D + ", " + Q.ROI + " SELECT i, j, round(d, 6) AS d FROM dist WHERE d < 0.5 UNION ALL SELECT roi_id, -5, 7.0 FROM roi UNION ALL SELECT -5, roi_id, 7.0 FROM roi")
def attach_hub(spark, d):
    return G.attach_hub(distances(spark, d).where("d < 0.5"), H.roi(spark, d), -5, 7.0).select("i", "j", F.round("d", 6).alias("d"))


@register("default_cutoff", _G.rstrip() + ", " + _D + " SELECT round(avg(d) + stddev_pop(d), 6) AS cutoff FROM dist")
def default_cutoff(spark, d):
    return spark.createDataFrame([(round(G.default_cutoff(distances(spark, d)), 6),)], "cutoff double")


@register("isotonic_calibration")
def isotonic_calibration(spark, d):
    g = graph(spark, d)  # found anew in each of three passes: stored, it is the largest table of all
    tables = C.calibrate_features(g, ["s_nn", "s_swt"], BINS, WINDOW)
    return C.naive_bayes(g, tables).select("i", "j", F.round("p_same", 6).alias("p_same"))


@register("mixing_search")
def mixing_search(spark, d):
    from tessera.operators.search import mixing_search as search

    best = search(graph(spark, d), {"s_nn": (0.4, 6.0), "s_swt": (0.2, 6.0)}, BINS, WINDOW, generations=10)
    return spark.createDataFrame([(float(best["loss"]), float(best["p_norm"]), float(best["powers"]["s_nn"]), float(best["powers"]["s_swt"]))], "loss double, p_norm double, power_nn double, power_swt double")


@register("noise_rescue")
def noise_rescue(spark, d):
    """Class labels thinned to one object a session are the clusters; all others are to be rescued."""
    r = H.roi(spark, d)
    first = r.where("label >= 0").groupBy("session_id", "label").agg(F.min("roi_id").alias("roi_id")).select("roi_id", F.lit(True).alias("own"))
    labels = r.join(first, "roi_id", "left").select("roi_id", "session_id", F.when(F.col("own"), F.col("label")).otherwise(-1).cast("bigint").alias("label"))
    return G.noise_rescue(distances(spark, d).where("inter"), labels, 0.62)


@register("constrained_clustering")
def constrained_clustering(spark, d):
    return G.cluster(cut(distances(spark, d).where("d < 0.62")), H.roi(spark, d), rescue_cutoff=0.62)


@register("sequential_assignment")
def sequential_assignment(spark, d):
    return G.sequential_assignment(distances(spark, d).where("d < 0.6"), H.roi(spark, d))[0]


@register("pca_variance")
def pca_variance(spark, d):
    from tessera.operators.classify import pca

    found = pca(H.latent(spark, d, "nn"), 5)
    return spark.createDataFrame([(k, float(round(v, 6)), float(round(r, 6))) for k, (v, r) in enumerate(zip(found["variance"], found["ratio"], strict=True))], "component int, variance double, ratio double")


@register("logistic_autotune")
def logistic_autotune(spark, d):
    from tessera.operators.classify import autotune, predict

    rows = H.latent(spark, d, "nn").join(H.roi(spark, d).select("roi_id", "label"), "roi_id").where("label >= 0")
    classes = list(range(9))
    model, _ = autotune(rows, classes, (0.1, 1.0), max_iter=15)
    return predict(model, rows, classes).select("roi_id", "label", "predicted", F.round(F.array_max("proba"), 4).alias("confidence"))


@register("mutual_nn_match")
def mutual_nn_match(spark, d):
    v = H.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return M.mutual_match(v.where("id % 2 = 0"), v.where("id % 2 = 1")).select("t", "m", F.round("d", 6).alias("d"))


@register("phase_correlation")
def phase_correlation(spark, d):
    from tessera.operators.align import register_pairs, to_template

    f = H.footprint(spark, d).groupBy("session_id", "pixel").agg(F.max("weight").alias("v"))
    height = H.frame_height(f, 40)
    grid = f.select("session_id").distinct().crossJoin(F.broadcast(spark.range(height * 40).toDF("pixel")))
    cells = grid.join(f, ["session_id", "pixel"], "left").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("pixel", F.coalesce("v", F.lit(0.0)).alias("v")))).alias("m"))
    fov = cells.select("session_id", F.col("m.v").alias("img"))
    s = fov.select(F.col("session_id").alias("a"))
    pairs = s.crossJoin(F.broadcast(s.toDF("b"))).where("a < b")
    return to_template(register_pairs(fov, pairs, height, 40), 0, 0.0)
