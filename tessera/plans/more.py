"""Queries of the remaining small operators."""

from __future__ import annotations

import uuid
from types import SimpleNamespace

from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import calibrate as C
from tessera.operators import ids
from tessera.operators import quality as U
from tessera.operators import similarity as M
from tessera.operators import spatial as P
from tessera.plans import graphs as G
from tessera.plans import sql as Q
from tessera.plans.registry import register
from tessera.sources import files
from tessera.sources import harness as H


@register("quality_inclusion", Q.with_(Q.NN, Q.EDGES, Q.ROI) + """, e AS (SELECT a.label AS li, b.label AS lj, s FROM edges JOIN roi a ON a.roi_id = i JOIN roi b ON b.roi_id = j),
n AS (SELECT label, count(*) AS n FROM roi GROUP BY 1),
q AS (SELECT label, (m - o) / greatest(m, o) AS good FROM (SELECT n.label, coalesce(sum(s) FILTER (li = lj), 0) / (n.n * (n.n - 1)) AS m, coalesce(max(s) FILTER (li <> lj), 0) AS o FROM n LEFT JOIN e ON li = n.label GROUP BY n.label, n.n)),
full_ AS (SELECT r.roi_id, r.label AS own, n.label AS other, coalesce(sum(1 - e.s), 0) AS total, count(e.s) AS c, any_value(n.n - (n.label = r.label)::INTEGER) AS m
  FROM roi r CROSS JOIN n LEFT JOIN (SELECT i, s, roi.label AS lj FROM edges JOIN roi ON roi.roi_id = j) e ON e.i = r.roi_id AND e.lj = n.label GROUP BY r.roi_id, r.label, n.label),
ab AS (SELECT roi_id, own AS label, max((total + (m - c) * 2.0) / m) FILTER (own = other) AS a, min((total + (m - c) * 2.0) / m) FILTER (own <> other) AS b FROM full_ GROUP BY ALL),
sil AS (SELECT roi_id, label, (b - a) / greatest(a, b) AS s FROM ab)
SELECT roi_id, sil.label FROM sil JOIN q ON q.label = sil.label WHERE good > (SELECT avg(good) FROM q) AND s > (SELECT avg(s) FROM sil)""")
def quality_inclusion(spark, d):
    """Objects above the mean silhouette of objects, in clusters above the mean silhouette of clusters."""
    from tessera.operators.checkpoints import cut
    from tessera.pipeline import good_samples

    e, r = G.edges(spark, d), H.roi(spark, d)
    clusters = cut(U.cluster_quality(e, r))
    samples = cut(U.sample_silhouette(e.select("i", "j", (F.lit(1.0) - F.col("s")).alias("d")), r, fill=2.0))
    bound = lambda rows: rows.agg(F.avg("silhouette")).first()[0]
    return good_samples(SimpleNamespace(clusters=clusters, samples=samples), bound(clusters), bound(samples)).select("roi_id", "label")


@register("neuropil_masks", "SELECT roi_id, pixel FROM (SELECT l_suppkey AS roi_id, unnest(list(l_partkey)) AS pixel FROM lineitem GROUP BY 1)")
def neuropil_masks(spark, d):
    x = H.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("roi_id")).agg(F.collect_list("l_partkey").alias("neuropil_mask"))
    return P.neuropil(x)


@register("natural_order", "SELECT name, row_number() OVER (ORDER BY regexp_extract(name, '^[^0-9]*'), k)::INTEGER AS place FROM (SELECT 'file' || p_partkey || '.npy' AS name, p_partkey AS k FROM part)")
def natural_order(spark, d):
    from tessera.operators.order import numbered

    names = H.table(spark, d, "part").select(F.concat(F.lit("file"), F.col("p_partkey"), F.lit(".npy")).alias("name"))
    keyed = names.withColumn("k", files.natural_key(F.col("name")))
    return numbered(keyed, "k", "name", kind="int").select("name", (F.col("place") + 1).alias("place"))


@register("content_hashes", "SELECT p_partkey, md5(p_name) AS md5, sha256(p_name) AS sha256 FROM part")
def content_hashes(spark, d):
    return H.table(spark, d, "part").select("p_partkey", F.md5(F.col("p_name").cast("binary")).alias("md5"), F.sha2(F.col("p_name").cast("binary"), 256).alias("sha256"))


@register("hash_differences", "SELECT p_name AS path FROM part GROUP BY 1 HAVING sha256(p_name) <> sha256(CASE WHEN min(p_partkey) % 10 = 0 THEN p_name || '!' ELSE p_name END)")
def hash_differences(spark, d):
    p = H.table(spark, d, "part").groupBy(F.col("p_name").alias("path")).agg(F.min("p_partkey").alias("k"))
    found = p.select("path", F.sha2("path", 256).alias("sha256"))
    other = p.select("path", F.sha2(F.when(F.col("k") % 10 == 0, F.concat("path", F.lit("!"))).otherwise(F.col("path")), 256).alias("sha256"))
    return files.compare_hashes(found, other).select("path")


@register("flow_remap", "SELECT s_suppkey AS y, s_nationkey AS x, s_acctbal / 1000 AS dy, s_acctbal / 500 AS dx FROM supplier".replace("s_acctbal / 1000 AS dy, s_acctbal / 500 AS dx", "round(s_acctbal / 1000, 6) AS dy, round(s_acctbal / 500, 6) AS dx"))
def flow_remap(spark, d):
    """Flow to absolute coordinates and back."""
    flow = H.table(spark, d, "supplier").select(F.lit(0).alias("session_id"), F.col("s_suppkey").alias("y"), F.col("s_nationkey").alias("x"), (F.col("s_acctbal") / 1000).alias("dy"), (F.col("s_acctbal") / 500).alias("dx"))
    return P.remap_to_flow(P.flow_to_remap(flow)).select("y", "x", F.round("dy", 6).alias("dy"), F.round("dx", 6).alias("dx"))


@register("scale_factor", "SELECT p_partkey, round(p_size * 1.2 * 48 / 36, 6) AS factor FROM part")
def scale_factor(spark, d):
    return H.table(spark, d, "part").select("p_partkey", F.round(P.scale_factor(F.col("p_size").cast("double"), 48), 6).alias("factor"))


@register("gray_to_rgb", Q.with_(Q.NN) + "SELECT roi_id, 3 AS channels, round(vec[1] + 2 * vec[2], 6) + 0.0 AS check_ FROM nn")
def gray_to_rgb(spark, d):
    rgb = H.latent(spark, d, "nn").select("roi_id", S.to_rgb(F.col("vec")).alias("c"))
    return rgb.select("roi_id", F.size("c").alias("channels"), (F.round(F.get(F.get("c", F.lit(0)), F.lit(0)) + 2 * F.get(F.get("c", F.lit(2)), F.lit(1)), 6) + 0.0).alias("check_"))


@register("nan_to_constant", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN -1.0 ELSE l_tax END AS v FROM lineitem")
def nan_to_constant(spark, d):
    x = F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    return H.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.nan_to(x, -1.0).alias("v"))


@register("clip_and_snap", "SELECT l_orderkey, l_linenumber, CASE WHEN v > 1 - 1e-5 THEN 1.0 ELSE round(v, 6) END AS v FROM (SELECT *, least(greatest(l_discount * 12 - 0.1, 0), 1) AS v FROM lineitem)")
def clip_and_snap(spark, d):
    return H.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.snap_to_one(S.clip(F.col("l_discount") * 12 - 0.1, 0.0, 1.0)), 6).alias("v"))


@register("label_variants", Q.with_(Q.UCID) + "SELECT ucid, count(*) AS n, count(DISTINCT session_id) AS sessions FROM ucid GROUP BY ucid")
def label_variants(spark, d):
    return ids.by_label(H.ucid(spark, d))


@register("jaccard_blend", Q.with_(Q.NN, Q.EDGES) + """, t AS (SELECT p.i, p.j, sum(least(a.s, b.s)) AS lo FROM edges p JOIN edges a ON a.i = p.i AND a.j <> p.j JOIN edges b ON b.i = p.j AND b.j = a.j AND b.j <> p.i GROUP BY ALL),
w AS (SELECT i, sum(s) AS w FROM edges GROUP BY i)
SELECT e.i, e.j, round(0.4 * coalesce(lo, 0) / greatest(x.w + y.w - 2 * s - coalesce(lo, 0), 1e-12) * (x.w + y.w - 2 * s - coalesce(lo, 0) > 1e-12)::INTEGER + 0.6 * s, 6) AS s
FROM edges e LEFT JOIN t USING (i, j) JOIN w x ON x.i = e.i JOIN w y ON y.i = e.j""")
def jaccard_blend(spark, d):
    found = M.dense_jaccard(H.vectors(spark, d).select("roi_id", F.col("s_nn").alias("vec")), G.LEAST)
    return M.mirror(M.blend_jaccard(found, 0.4)).select("i", "j", F.round("s", 6).alias("s"))


@register("prune_by_crossover", G._B.rstrip() + ", " + G._PEAK + f", cut_ AS (SELECT (SELECT min(d) FROM dist) + ((k + 1) / {G.BINS}.0 - (SELECT min(d) FROM dist)) * 0.9 AS c FROM cross_) SELECT i, j, round(d, 6) AS d FROM dist, cut_ WHERE d < c")
def prune_by_crossover(spark, d):
    return C.prune(G.distances(spark, d), 0.9, n=G.BINS, window=G.WINDOW).select("i", "j", F.round("d", 6).alias("d"))


@register("score_labels")
def score_labels(spark, d):
    found = U.score_labels(G._judged(spark, d))
    return spark.createDataFrame([(k, float(round(v, 6)) if v is not None else None) for k, v in sorted(found.items())], "score string, value double")


@register("scattering_features")
def scattering_features(spark, d):
    from tessera.operators.images import scattering_latents

    img = H.table(spark, d, "embeddings").select(F.col("vec_id").alias("roi_id"), F.transform("embedding", lambda x: x.cast("double")).alias("img"))
    return scattering_latents(img, 8, 8, angles=4).select("roi_id", F.size("vec").alias("width"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@register("tracking_pipeline")
def tracking_pipeline(spark, d):
    """Suppliers tracked by the parts they deliver, nation groups as sessions."""
    from tessera.operators.checkpoints import cut
    from tessera.operators.overlap import pack, unpack
    from tessera.operators.spatial import centroid
    from tessera.pipeline import track

    f = cut(pack(H.footprint(spark, d, near=True)))
    roi = cut(f.select("roi_id").join(H.footprint_sessions(spark, d).distinct(), "roi_id").join(centroid(unpack(f), 40), "roi_id"))
    params = {"frame": {"height": 500, "width": 40}, "normalization": {"k_min": 1, "k_max": 4}, "mixing": {"method": "manual"}, "pruning": {"d_cutoff": 0.85}}
    return track(f, roi, {"nn": H.latent(spark, d, "nn")}, params).labels


@register("stat_files", """SELECT session_id, roi_idx, pixel, round(lam / (1.0 + k + 2), 9) AS weight FROM (
  SELECT n_regionkey::INTEGER AS session_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS roi_idx, n_nationkey AS k, unnest([k * 40 + 2, k * 40 + 3, (k + 1) * 40 + 2]) AS pixel, unnest([1.0, k, 2.0]) AS lam FROM nation)""")
def stat_files(spark, d):
    """Nations as objects, regions as sessions: written as a recording's files, each in a folder of its own, and read again."""
    from tessera.operators.checkpoints import shared_folder

    root = f"{shared_folder(spark)}/stat-files-{uuid.uuid4().hex[:12]}"
    found = H.table(spark, d, "nation").select("n_regionkey", "n_nationkey").orderBy("n_regionkey", "n_nationkey").collect()  # a table of fixed size
    paths = []
    for region in sorted({r["n_regionkey"] for r in found}):
        keys = [r["n_nationkey"] for r in found if r["n_regionkey"] == region]
        paths.append(f"{root}/s{region}/plane0/stat.npy")
        files.write_stat(spark, paths[-1], [{"ypix": [k, k, k + 1], "xpix": [2, 3, 2], "lam": [1.0, float(k), 2.0]} for k in keys])
    return files.stat_to_footprint(files.read_stat(spark, paths), 40).select("session_id", "roi_idx", "pixel", F.round("weight", 9).alias("weight"))
