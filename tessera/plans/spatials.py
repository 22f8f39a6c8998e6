"""Queries over sparse footprints and pixel grids. A part key stands for a pixel of a frame of width 40."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.operators import similarity as M
from tessera.operators import spatial as P
from tessera.plans import sql as Q
from tessera.plans.registry import register
from tessera.sources import harness as H

WIDTH = 40
_FP = Q.with_(Q.FOOTPRINT)
_NORM = "norm AS (SELECT roi_id, session_id, pixel, weight / sum(weight) OVER (PARTITION BY roi_id) AS w FROM footprint)"
_CENTRE = "centre AS (SELECT roi_id, round_even(sum(weight * (pixel // 40)) / (sum(weight) + 1e-12), 0)::BIGINT AS cy, round_even(sum(weight * (pixel % 40)) / (sum(weight) + 1e-12), 0)::BIGINT AS cx FROM footprint GROUP BY roi_id)"


@register("row_normalize", _FP + "SELECT roi_id, pixel, round(weight * 0.5 / sum(weight) OVER (PARTITION BY roi_id), 9) AS weight FROM footprint")
def row_normalize(spark, d):
    return M.row_normalize(H.footprint(spark, d), 0.5).select("roi_id", "pixel", F.round("weight", 9).alias("weight"))


@register("row_max_normalize", _FP + "SELECT roi_id, pixel, round(weight / greatest(max(weight) OVER (PARTITION BY roi_id), 1e-12), 9) AS weight FROM footprint")
def row_max_normalize(spark, d):
    return M.row_max_normalize(H.footprint(spark, d)).select("roi_id", "pixel", F.round("weight", 9).alias("weight"))


@register("footprint_similarity", Q.with_(Q.FOOTPRINT, _NORM, "mass AS (SELECT roi_id, sum(w) AS m FROM norm GROUP BY 1)") + """
SELECT i, j, round(1 - l1 / 2, 6) AS s FROM (
  SELECT i, j, a.m + b.m - summed + apart AS l1 FROM (
    SELECT x.roi_id AS i, y.roi_id AS j, sum(x.w + y.w) AS summed, sum(abs(x.w - y.w)) AS apart FROM norm x JOIN norm y ON x.pixel = y.pixel AND x.roi_id < y.roi_id GROUP BY ALL)
  JOIN mass a ON a.roi_id = i JOIN mass b ON b.roi_id = j)
WHERE 1 - l1 / 2 >= 1e-5""")
def footprint_similarity(spark, d):
    return M.footprint_similarity(H.footprint(spark, d)).select("i", "j", F.round("s", 6).alias("s"))


@register("centroid_com", Q.with_(Q.FOOTPRINT, _CENTRE) + "SELECT * FROM centre")
def centroid_com(spark, d):
    return P.centroid(H.footprint(spark, d), WIDTH)


@register("centroid_median", _FP + "SELECT roi_id, round_even((SELECT quantile_cont(DISTINCT y, 0.5) FROM (SELECT pixel // 40 AS y FROM footprint f WHERE f.roi_id = s.roi_id AND pixel // 40 > 0)), 0)::BIGINT AS cy, round_even((SELECT quantile_cont(DISTINCT x, 0.5) FROM (SELECT pixel % 40 AS x FROM footprint f WHERE f.roi_id = s.roi_id AND pixel % 40 > 0)), 0)::BIGINT AS cx FROM (SELECT DISTINCT roi_id FROM footprint) s")
def centroid_median(spark, d):
    return P.centroid(H.footprint(spark, d), WIDTH, "median")


@register("max_projection", _FP + "SELECT session_id, pixel, max(weight) AS v FROM footprint GROUP BY ALL")
def max_projection(spark, d):
    return P.max_projection(H.footprint(spark, d))


@register("max_projection_dense", _FP + "SELECT s.session_id, p.pixel, coalesce(v, 0) AS v FROM (SELECT DISTINCT session_id FROM footprint) s, (SELECT unnest(range((SELECT max(pixel) // 40 + 1 FROM footprint) * 40)) AS pixel) p LEFT JOIN (SELECT session_id, pixel, max(weight) AS v FROM footprint GROUP BY ALL) m ON m.session_id = s.session_id AND m.pixel = p.pixel")
def max_projection_dense(spark, d):
    f = H.footprint(spark, d)
    return P.densify(P.max_projection(f), f.select("session_id").distinct(), H.frame_height(f, WIDTH) * WIDTH)


@register("roi_crop", Q.with_(Q.FOOTPRINT, _CENTRE) + "SELECT * FROM (SELECT roi_id, pixel // 40 - cy + 6 AS y, pixel % 40 - cx + 6 AS x, weight FROM footprint JOIN centre USING (roi_id)) WHERE y BETWEEN 0 AND 11 AND x BETWEEN 0 AND 11")
def roi_crop(spark, d):
    f = H.footprint(spark, d)
    return P.crop(f, P.centroid(f, WIDTH), WIDTH, 12, 12)


_KERNEL = "k0 AS (SELECT y - 2 AS dy, x - 2 AS dx, (cos(least(sqrt(pow(y - 2, 2) + pow(x - 2, 2)) / 3 * pi(), pi())) + 1) / 2 AS v FROM range(5) a(y), range(5) b(x)), kernel AS (SELECT dy, dx, v / (SELECT sum(v) FROM k0) AS k FROM k0 WHERE v > 0)"


@register("sparse_blur", Q.with_(Q.FOOTPRINT, _KERNEL) + "SELECT roi_id, y * 40 + x AS pixel, round(sum(w), 6) AS weight FROM (SELECT roi_id, pixel // 40 + dy AS y, pixel % 40 + dx AS x, weight * k AS w FROM footprint, kernel) WHERE y BETWEEN 0 AND 499 AND x BETWEEN 0 AND 39 GROUP BY ALL")
def sparse_blur(spark, d):
    return P.blur(H.footprint(spark, d), 3, 500, WIDTH).select("roi_id", "pixel", F.round("weight", 6).alias("weight"))


_TILES = """ax AS (SELECT k, 64 + k * (512 - 128) / 7.0 AS c FROM range(8) t(k)),
side AS (SELECT k, CASE WHEN floor(c - 64) > 0 AND floor(c - 64) < 512 THEN floor(c - 64) ELSE 0 END::BIGINT AS low, CASE WHEN floor(c + 64) > 0 AND floor(c + 64) < 512 THEN floor(c + 64) ELSE 512 END::BIGINT AS high FROM ax)"""


@register("tile_grid", Q.with_(_TILES) + "SELECT a.k * 1000000 + b.k AS block_id, b.low AS y0, b.high AS y1, a.low AS x0, a.high AS x1 FROM side a, side b")
def tile_grid(spark, d):
    return P.tiles(spark, 512, 512, 128, 128, 0.5)


@register("block_candidates", Q.with_(Q.ROI, _TILES, "member AS (SELECT roi_id, a.k * 1000000 + b.k AS block_id FROM roi JOIN side a ON cx >= a.low AND cx < a.high JOIN side b ON cy >= b.low AND cy < b.high)") + "SELECT DISTINCT a.roi_id AS i, b.roi_id AS j FROM member a JOIN member b ON a.block_id = b.block_id AND a.roi_id < b.roi_id")
def block_candidates(spark, d):
    points = H.roi(spark, d).select("roi_id", (F.col("cy") * 512 + F.col("cx")).alias("pixel"), F.lit(1.0).alias("weight"))
    return P.block_candidates(P.block_members(points, P.tiles(spark, 512, 512, 128, 128, 0.5), 512))


@register("nearest_grid", _FP.replace("footprint AS", "unused AS") + ", " + Q.ROI + """, grid AS (SELECT 20.0 + a * 472 / 9.0 AS gy, 20.0 + b * 472 / 9.0 AS gx FROM range(10) x(a), range(10) y(b))
SELECT round(gy, 6) AS gy, round(gx, 6) AS gx, roi_id FROM (SELECT gy, gx, roi_id, sqrt(pow(cy - gy, 2) + pow(cx - gx, 2)) AS d FROM grid, roi) WHERE d <= 40 QUALIFY row_number() OVER (PARTITION BY gy, gx ORDER BY d, roi_id) = 1""")
def nearest_grid(spark, d):
    points = H.roi(spark, d).select("roi_id", F.col("cy").cast("double").alias("y"), F.col("cx").cast("double").alias("x"))
    return P.nearest_grid(points, spark, 10, 20.0, 492.0, 40.0).select(F.round("gy", 6).alias("gy"), F.round("gx", 6).alias("gx"), "roi_id")


@register("bbox_by_label", _FP + "SELECT session_id AS label, min(pixel // 40) AS y0, max(pixel // 40) AS y1, min(pixel % 40) AS x0, max(pixel % 40) AS x1 FROM footprint WHERE weight > 0 GROUP BY 1")
def bbox_by_label(spark, d):
    f = H.footprint(spark, d)
    return P.bounds_by_label(f, f.select("roi_id", F.col("session_id").alias("label")).distinct(), WIDTH)


@register("border_mask", _FP + "SELECT session_id, pixel, CASE WHEN pixel // 40 >= 3 AND pixel // 40 < (SELECT max(pixel) // 40 - 2 FROM footprint) AND pixel % 40 >= 3 AND pixel % 40 < 37 THEN v ELSE 0 END AS v FROM (SELECT session_id, pixel, max(weight) AS v FROM footprint GROUP BY ALL)")
def border_mask(spark, d):
    f = H.footprint(spark, d)
    return P.border_mask(P.max_projection(f), H.frame_height(f, WIDTH), WIDTH, 3)


@register("colour_overlay", _FP + "SELECT session_id, pixel, channel::INTEGER AS channel, max(weight * CASE channel WHEN 0 THEN roi_id % 3 WHEN 1 THEN roi_id % 5 ELSE 1 END)::DOUBLE AS v FROM footprint, range(3) c(channel) GROUP BY ALL")
def colour_overlay(spark, d):
    f = H.footprint(spark, d)
    labels = f.select("roi_id", F.col("roi_id").alias("label")).distinct()
    colours = labels.select("label", F.array((F.col("label") % 3).cast("double"), (F.col("label") % 5).cast("double"), F.lit(1.0)).alias("rgb"))
    return P.colour_overlay(f, labels, colours)


@register("warp_algebra", """SELECT s_suppkey, round(a * x + 0.25 * y + 3, 6) AS sx, round(b * y - 1, 6) AS sy, round((x - 3 - 0.25 * (y + 1) / b) / a, 6) AS back_x, round((y + 1) / b, 6) AS back_y FROM (
  SELECT s_suppkey, 1.0 + s_suppkey % 3 AS a, 0.5 + s_suppkey % 2 AS b, 2 * s_suppkey % 7 AS x, s_suppkey % 5 AS y FROM supplier)""")
def warp_algebra(spark, d):
    """A supplier's own scale and shear, then a shift, applied to a point; and the inverse of both to the same point."""
    number = lambda x: x.cast("double") if isinstance(x, Column) else F.lit(float(x))
    matrix = lambda *v: F.array(*map(number, v))
    k = F.col("s_suppkey")
    s = H.table(spark, d, "supplier").select("s_suppkey", P.compose(matrix(1, 0, 3, 0, 1, -1, 0, 0, 1), matrix(1 + k % 3, 0.25, 0, 0, 0.5 + k % 2, 0, 0, 0, 1)).alias("m"))
    y, x = (k % 5).cast("double"), (2 * k % 7).cast("double")
    s = s.select("s_suppkey", P.warp_to_remap(F.col("m"), y, x).alias("r"), P.warp_to_remap(P.invert_warp(F.col("m")), y, x).alias("b"))
    return s.select("s_suppkey", *(F.round(c, 6).alias(n) for c, n in (("r.sx", "sx"), ("r.sy", "sy"), ("b.sx", "back_x"), ("b.sy", "back_y"))))


_IMG = "img AS (SELECT session_id, pixel // 40 AS y, pixel % 40 AS x, max(weight) AS v FROM footprint GROUP BY ALL)"


@register("remap_bilinear", Q.with_(Q.FOOTPRINT, _IMG) + """SELECT session_id, y, x, round(sum(k * coalesce(v, 0)), 6) AS v FROM (
  SELECT g.session_id, g.y, g.x, n.k, img.v FROM (SELECT session_id, y, x FROM (SELECT DISTINCT session_id FROM img), (SELECT unnest(range(max(y) + 1)) AS y FROM img) a, range(40) b(x)) g,
    (VALUES (0, 0, 0.375), (0, 1, 0.375), (1, 0, 0.125), (1, 1, 0.125)) n(dy, dx, k)
  LEFT JOIN img ON img.session_id = g.session_id AND img.y = g.y + n.dy + 1 AND img.x = g.x + n.dx) GROUP BY ALL""")
def remap_bilinear(spark, d):
    """Every pixel, to every place of a frame that holds them all."""
    f = H.footprint(spark, d)
    image = f.groupBy("session_id", F.floor(F.col("pixel") / WIDTH).cast("bigint").alias("y"), (F.col("pixel") % WIDTH).alias("x")).agg(F.max("weight").alias("v"))
    ys = spark.range(H.frame_height(f, WIDTH)).toDF("y").crossJoin(spark.range(WIDTH).toDF("x"))
    flow = image.select("session_id").distinct().crossJoin(F.broadcast(ys)).withColumns({"dy": F.lit(1.25), "dx": F.lit(0.5)})
    return P.remap_bilinear(image, P.flow_to_remap(flow)).select("session_id", "y", "x", F.round("v", 6).alias("v"))


_FOV = "fov AS (SELECT session_id, pixel, (v - (SELECT min(v) FROM p)) / ((SELECT max(v) FROM p) - (SELECT min(v) FROM p)) AS v FROM p), drawn AS (SELECT session_id, pixel, sum(weight / m) AS r FROM (SELECT *, max(weight) OVER (PARTITION BY roi_id) AS m FROM footprint) GROUP BY ALL)"


@register("mix_fov", _FP.rstrip() + ", p AS (SELECT session_id, pixel, max(weight) AS v FROM footprint GROUP BY ALL), " + _FOV + " SELECT session_id, pixel, round(v * 0.75 + coalesce(r, 0) * (SELECT avg(v) FROM fov) * 0.0625, 6) AS v FROM fov LEFT JOIN drawn USING (session_id, pixel)")
def mix_fov(spark, d):
    f = H.footprint(spark, d)
    return P.mix_footprints(P.global_minmax(P.max_projection(f)), f, 0.25).select("session_id", "pixel", F.round("v", 6).alias("v"))


_BORDERS = ("replicate", "reflect", "wrap")
_KEYS = "CASE WHEN d <= 1 THEN 1.25 * d * d * d - 2.25 * d * d + 1 ELSE -0.75 * d * d * d + 3.75 * d * d - 6 * d + 3 END"


@register("remap_borders", Q.with_(Q.FOOTPRINT, _IMG, "h AS (SELECT max(y) + 1 AS h FROM img)",
  f"ky AS (SELECT i AS dy, {_KEYS} AS wy FROM (SELECT i, abs(0.25::DOUBLE - (i - 1)) AS d FROM range(4) r(i)))",
  f"kx AS (SELECT i - 1 AS dx, {_KEYS} AS wx FROM (SELECT i, abs(0.5::DOUBLE - (i - 1)) AS d FROM range(4) r(i)))",
  """taps AS (SELECT border, session_id, y, x, wy * wx AS k,
    CASE border WHEN 'replicate' THEN least(y + dy, h - 1) WHEN 'wrap' THEN (y + dy) % h ELSE least(y + dy, 2 * h - 1 - y - dy) END AS ny,
    CASE border WHEN 'replicate' THEN greatest(least(x + dx, 39), 0) WHEN 'wrap' THEN (x + dx + 40) % 40 ELSE CASE WHEN x + dx < 0 THEN -1 - x - dx ELSE least(x + dx, 79 - x - dx) END END AS nx
    FROM (SELECT DISTINCT session_id FROM img), h, (SELECT unnest(range(h)) AS y FROM h), range(40) b(x), ky, kx, (VALUES ('replicate'), ('reflect'), ('wrap')) m(border))""")
  + "SELECT border, taps.session_id, taps.y, taps.x, round(sum(k * coalesce(v, 0)), 6) AS v FROM taps LEFT JOIN img ON img.session_id = taps.session_id AND img.y = ny AND img.x = nx GROUP BY ALL")
def remap_borders(spark, d):
    """Every pixel, moved by cubic interpolation under each border."""
    f = H.footprint(spark, d)
    height = H.frame_height(f, WIDTH)
    image = f.groupBy("session_id", F.floor(F.col("pixel") / WIDTH).cast("bigint").alias("y"), (F.col("pixel") % WIDTH).alias("x")).agg(F.max("weight").alias("v"))
    places = spark.range(height).toDF("y").crossJoin(spark.range(WIDTH).toDF("x"))
    flow = image.select("session_id").distinct().crossJoin(F.broadcast(places)).withColumns({"dy": F.lit(1.25), "dx": F.lit(0.5)})
    drawn = [P.remap_image(image, P.flow_to_remap(flow), "cubic", border, frame=(height, WIDTH)).withColumn("border", F.lit(border)) for border in _BORDERS]
    return functools.reduce(lambda a, b: a.unionByName(b), drawn).select("border", "session_id", "y", "x", F.round("v", 6).alias("v"))


@register("warp_footprints", _FP + "SELECT roi_id, session_id, pixel, round(w / sum(w) OVER (PARTITION BY roi_id), 9) AS weight FROM (SELECT roi_id, session_id, (pixel // 40 + 2) * 40 + pixel % 40 + 1 AS pixel, weight AS w FROM footprint WHERE pixel // 40 + 2 <= (SELECT max(pixel) // 40 FROM footprint) AND pixel % 40 + 1 < 40)")
def warp_footprints(spark, d):
    """All footprints, in a frame that holds every pixel."""
    f = H.footprint(spark, d)
    shifts = spark.range(8).select(F.col("id").cast("int").alias("session_id"), F.lit(2).alias("dy"), F.lit(1).alias("dx"))
    return P.warp_footprints(f, P.shift_remap(spark, shifts, H.frame_height(f, WIDTH), WIDTH), WIDTH).select("roi_id", "session_id", "pixel", F.round("weight", 9).alias("weight"))


@register("polygon_region", Q.with_(Q.ROI) + "SELECT roi_id FROM roi WHERE cy >= 100 AND cy < 300 AND cx >= 50 + (cy - 100) * 0.5 AND cx < 350 - (cy - 100) * 0.25")
def polygon_region(spark, d):
    return H.roi(spark, d).where(P.in_polygon(F.col("cy").cast("double"), F.col("cx").cast("double"), [(100.0, 50.0), (100.0, 350.0), (300.0, 300.0), (300.0, 150.0)])).select("roi_id")


@register("stat_to_footprint", "SELECT session_id, roi_idx, pixel, round(sum(lam) / any_value(total), 9) AS weight FROM (SELECT (s % 8)::INTEGER AS session_id, s AS roi_idx, (p // 40 + 1) * 40 + p % 40 + 2 AS pixel, q AS lam, sum(q) OVER (PARTITION BY s) AS total FROM (SELECT l_suppkey AS s, l_partkey AS p, l_quantity AS q FROM lineitem)) GROUP BY session_id, roi_idx, pixel")
def stat_to_footprint(spark, d):
    from tessera.sources.files import stat_to_footprint as scan

    x = H.table(spark, d, "lineitem")
    one = F.struct(F.floor(F.col("l_partkey") / WIDTH).cast("int").alias("y"), (F.col("l_partkey") % WIDTH).cast("int").alias("x"), F.col("l_quantity").alias("w"))
    stat = x.groupBy((F.col("l_suppkey") % 8).cast("int").alias("session_id"), F.col("l_suppkey").alias("roi_idx")).agg(F.collect_list(one).alias("r"))
    stat = stat.select("session_id", "roi_idx", F.col("r.y").alias("ypix"), F.col("r.x").alias("xpix"), F.col("r.w").alias("lam"))
    shifts = spark.range(8).select(F.col("id").cast("int").alias("session_id"), F.lit(1).alias("dy"), F.lit(2).alias("dx"))
    return scan(stat, WIDTH, shifts).select("session_id", "roi_idx", "pixel", F.round("weight", 9).alias("weight"))


@register("row_normalize_power", _FP + "SELECT roi_id, pixel, round(pow(weight, 1.5) / sum(pow(weight, 1.5)) OVER (PARTITION BY roi_id), 9) AS weight FROM footprint")
def row_normalize_power(spark, d):
    return M.row_normalize(H.footprint(spark, d), 1.0, 1.5).select("roi_id", "pixel", F.round("weight", 9).alias("weight"))
