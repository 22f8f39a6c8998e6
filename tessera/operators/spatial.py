"""Footprints on the pixel grid: centroids, projections, crops, blur, tiles, overlays, warps."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import scalar as S
from tessera.operators.checkpoints import cut


def _y(width: int) -> Column:
    return F.floor(F.col("pixel") / width).cast("bigint")


def _x(width: int) -> Column:
    return (F.col("pixel") % width).cast("bigint")


def centroid(footprint: DataFrame, width: int, method: str = "centerOfMass") -> DataFrame:
    """``roi_id, cy, cx``: rounded centre of mass, or median of the distinct occupied rows and columns.

    Halves round to even. In the median, row 0 and column 0 never count, as in the
    behaviour this mirrors.
    """
    w = F.col("weight")
    if method == "centerOfMass":
        both = footprint.groupBy("roi_id").agg((F.sum(w * _y(width)) / (F.sum(w) + S.TINY)).alias("cy"), (F.sum(w * _x(width)) / (F.sum(w) + S.TINY)).alias("cx"))
    elif method == "median":
        used = footprint.where(w != 0)
        ys = used.select("roi_id", _y(width).alias("v")).where("v > 0").distinct().groupBy("roi_id").agg(F.percentile("v", F.lit(0.5)).alias("cy"))
        xs = used.select("roi_id", _x(width).alias("v")).where("v > 0").distinct().groupBy("roi_id").agg(F.percentile("v", F.lit(0.5)).alias("cx"))
        both = ys.join(xs, "roi_id", "full")
    else:
        raise ValueError("method is centerOfMass or median")
    return both.select("roi_id", F.bround("cy").cast("bigint").alias("cy"), F.bround("cx").cast("bigint").alias("cx"))


def max_projection(footprint: DataFrame, normalize: bool = False) -> DataFrame:
    """``session_id, pixel, v``: greatest weight at each occupied pixel; absent pixels are 0."""
    f = footprint
    if normalize:
        f = f.withColumn("weight", F.col("weight") / F.greatest(F.max("weight").over(Window.partitionBy("roi_id")), F.lit(S.TINY)))
    return f.groupBy("session_id", "pixel").agg(F.max("weight").alias("v"))


def densify(entries: DataFrame, keys: DataFrame, pixels: int, column: str = "v", fill: float = 0.0) -> DataFrame:
    """Every key with every pixel, absent ones filled."""
    grid = keys.withColumn("pixel", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(pixels - 1).cast("bigint"))))
    return grid.join(entries, [*keys.columns, "pixel"], "left").withColumn(column, F.coalesce(column, F.lit(fill)))


def crop(footprint: DataFrame, centroids: DataFrame, width: int, height: int = 36, crop_width: int = 36) -> DataFrame:
    """``roi_id, y, x, weight`` around the centroid; what falls outside is dropped."""
    top, left = (height + 1) // 2, (crop_width + 1) // 2
    moved = footprint.join(centroids, "roi_id").select("roi_id", (_y(width) - F.col("cy") + top).alias("y"), (_x(width) - F.col("cx") + left).alias("x"), "weight")
    return moved.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < crop_width))


def crop_images(cropped: DataFrame, height: int = 36, width: int = 36) -> DataFrame:
    """``roi_id, img``: dense row-major images; a crop has a fixed size."""
    cells = cropped.groupBy("roi_id").agg(F.map_from_entries(F.collect_list(F.struct((F.col("y") * width + F.col("x")).cast("int"), F.col("weight").cast("double")))).alias("m"))
    return cells.select("roi_id", F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("img"))


def blur_kernel(spark: SparkSession, half_width: int) -> DataFrame:
    """``dy, dx, k``: cosine kernel of sum one, its support ``max(2 * half_width - 1, 1)`` pixels across."""
    size = max(2 * half_width - 1, 1)
    k = S.cosine_kernel(spark, (size // 2, size // 2), size, size, float(2 * half_width))
    return k.select((F.col("y") - size // 2).alias("dy"), (F.col("x") - size // 2).alias("dx"), (F.col("v") / F.sum("v").over(Window.partitionBy())).alias("k")).where("k > 0")


def convolve(footprint: DataFrame, kernel: DataFrame, height: int, width: int, mode: str = "same") -> DataFrame:
    """Sparse 2-D convolution: each entry times each kernel offset, summed per pixel.

    ``same`` keeps the frame, ``full`` grows it by the kernel's reach on each side, ``valid``
    keeps the places where the whole kernel is inside. The kernel has a fixed size and is
    broadcast; there is no dense image anywhere.
    """
    if mode != "same":
        reach = kernel.agg(F.max(F.abs("dy")), F.max(F.abs("dx"))).first()
        grow = 1 if mode == "full" else -1
        ry, rx = reach[0] * grow, reach[1] * grow
        moved = footprint.withColumn("pixel", (_y(width) + ry) * (width + 2 * rx) + _x(width) + rx) if mode == "full" else footprint
        if mode == "full":
            return convolve(moved, kernel, height + 2 * ry, width + 2 * rx)
        whole = convolve(footprint, kernel, height, width)
        inside = (_y(width) >= -ry) & (_y(width) < height + ry) & (_x(width) >= -rx) & (_x(width) < width + rx)
        return whole.where(inside).withColumn("pixel", (_y(width) + ry) * (width + 2 * rx) + _x(width) + rx)
    spread = footprint.crossJoin(F.broadcast(kernel)).select("roi_id", "session_id", (_y(width) + F.col("dy")).alias("y"), (_x(width) + F.col("dx")).alias("x"), (F.col("weight") * F.col("k")).alias("w"))
    inside = spread.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))
    return inside.groupBy("roi_id", "session_id", (F.col("y") * width + F.col("x")).alias("pixel")).agg(F.sum("w").alias("weight"))


def blur(footprint: DataFrame, half_width: int, height: int, width: int) -> DataFrame:
    return footprint if not half_width else convolve(footprint, blur_kernel(footprint.sparkSession, half_width), height, width)


def tiles(spark: SparkSession, height: int, width: int, block_height: int, block_width: int, overlap: float = 0.0) -> DataFrame:
    """``block_id, y0, y1, x0, x1``: evenly placed blocks; those over the border are clamped to the frame."""

    def axis(frame: int, block: int, name: str) -> DataFrame:
        n = max(1, -(-frame * 1_000_000 // round((block - block * overlap) * 1_000_000)))
        half = block // 2
        first, last = half, frame - half
        centre = F.lit(float(first)) + F.col("id") * F.lit((last - first) / max(n - 1, 1))
        low, high = F.floor(centre - half), F.floor(centre + half)
        return spark.range(n).select(F.col("id").alias(f"k{name}"), F.when((low > 0) & (low < frame), low).otherwise(F.lit(0)).alias(f"{name}0"), F.when((high > 0) & (high < frame), high).otherwise(F.lit(frame)).alias(f"{name}1"))

    ys, xs = axis(height, block_height, "y"), axis(width, block_width, "x")
    return xs.crossJoin(F.broadcast(ys)).select((F.col("kx") * F.lit(1_000_000) + F.col("ky")).alias("block_id"), "y0", "y1", "x0", "x1")


def block_members(footprint: DataFrame, blocks: DataFrame, width: int) -> DataFrame:
    """``roi_id, block_id``: objects with a pixel in a block.

    Pixels and blocks meet in cells of the frame, of the size of the largest block, by an
    equi-join: a block lies in four cells at most.
    """
    tall, wide = blocks.agg(F.max(F.col("y1") - F.col("y0")), F.max(F.col("x1") - F.col("x0"))).first()
    if not tall or not wide:
        return footprint.join(blocks, F.lit(False)).select("roi_id", "block_id")
    cells = lambda low, high, size: F.sequence(F.floor(F.col(low) / size), F.floor((F.col(high) - 1) / size))
    spread = blocks.where("y1 > y0 AND x1 > x0").withColumn("cy", F.explode(cells("y0", "y1", tall))).withColumn("cx", F.explode(cells("x0", "x1", wide)))
    pixels = footprint.where("weight > 0").select("roi_id", _y(width).alias("y"), _x(width).alias("x"), F.floor(_y(width) / tall).alias("cy"), F.floor(_x(width) / wide).alias("cx"))
    return pixels.join(spread, ["cy", "cx"]).where("y >= y0 AND y < y1 AND x >= x0 AND x < x1").select("roi_id", "block_id").distinct()


#: Objects of a chunk of a class, and pairs that one task lists.
CLASS_CHUNK = 1000
PAIRS_A_TASK = 4_000_000


def block_candidates(members: DataFrame, chunk: int = CLASS_CHUNK) -> DataFrame:
    """``i, j``: pairs that share a block, once each.

    Objects of the same blocks are one class. Classes that share a block are found once each, so
    no pair arises twice and none is shuffled: classes meet as chunks of about ``chunk`` ids,
    and the pairs of two chunks are listed where these have met.
    """
    own = members.where("block_id IS NOT NULL").groupBy("roi_id").agg(F.array_sort(F.collect_set("block_id")).alias("blocks"))
    named = own.groupBy("blocks").agg(F.min("roi_id").alias("c"), F.count("*").alias("n"))
    dealt = own.join(named, "blocks").select("c", F.pmod(F.xxhash64("roi_id"), F.ceil(F.col("n") / chunk)).alias("k"), "roi_id")
    chunks = cut(dealt.groupBy("c", "k").agg(F.collect_list("roi_id").alias("ids")))
    at = cut(named.select("c", F.explode("blocks").alias("block_id")))
    classes = at.toDF("c", "block_id").join(at.toDF("d", "block_id"), "block_id").where("c <= d").select("c", "d").distinct()
    met = cut(classes.join(chunks.toDF("c", "k", "x"), "c").join(chunks.toDF("d", "l", "y"), "d").where("c < d OR k <= l"))
    n = met.agg(F.sum(F.size("x").cast("long") * F.size("y"))).first()[0] or 0
    pairs = met.repartition(max(1, -(-n // PAIRS_A_TASK)), "c", "d", "k", "l").withColumn("same", (F.col("c") == F.col("d")) & (F.col("k") == F.col("l")))
    listed = pairs.select("same", "y", F.explode("x").alias("a")).select("same", "a", F.explode("y").alias("b")).where("NOT same OR a < b")
    return listed.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))


def nearest_grid(points: DataFrame, spark: SparkSession, n: int, low: float, high: float, most: float) -> DataFrame:
    """``gy, gx, roi_id``: nearest point to each of ``n * n`` grid points, within ``most``.

    Points and grid meet in square cells of side ``most`` and their neighbours, by an
    equi-join; one aggregate with map-side minima.
    """
    step = (high - low) / (n - 1)
    grid = spark.range(n).select((F.lit(low) + F.col("id") * F.lit(step)).alias("gy")).crossJoin(spark.range(n).select((F.lit(low) + F.col("id") * F.lit(step)).alias("gx")))
    d = F.sqrt(F.pow(F.col("y") - F.col("gy"), F.lit(2.0)) + F.pow(F.col("x") - F.col("gx"), F.lit(2.0)))
    cell = lambda v: F.floor(v / F.lit(float(most)))
    around = lambda v: F.explode(F.array(cell(v) - 1, cell(v), cell(v) + 1))
    grid = grid.withColumn("cy", around(F.col("gy"))).withColumn("cx", around(F.col("gx")))
    near = points.withColumns({"cy": cell(F.col("y")), "cx": cell(F.col("x"))}).join(grid, ["cy", "cx"]).select("gy", "gx", "roi_id", d.alias("d")).where(F.col("d") <= most)
    return near.groupBy("gy", "gx").agg(F.min(F.struct("d", "roi_id")).alias("b")).select("gy", "gx", F.col("b.roi_id").alias("roi_id"), F.col("b.d").alias("d"))


def bounds_by_label(footprint: DataFrame, labels: DataFrame, width: int) -> DataFrame:
    """``label, y0, y1, x0, x1``: tight boxes of the occupied pixels."""
    used = footprint.where("weight > 0").join(labels.select("roi_id", "label"), "roi_id")
    return used.groupBy("label").agg(F.min(_y(width)).alias("y0"), F.max(_y(width)).alias("y1"), F.min(_x(width)).alias("x0"), F.max(_x(width)).alias("x1"))


def border_mask(pixels: DataFrame, height: int, width: int, border: int, fill: float = 0.0) -> DataFrame:
    inside = (_y(width) >= border) & (_y(width) < height - border) & (_x(width) >= border) & (_x(width) < width - border)
    return pixels.withColumn("v", F.when(inside, F.col("v")).otherwise(F.lit(fill)))


def colour_overlay(footprint: DataFrame, labels: DataFrame, colours: DataFrame) -> DataFrame:
    """``session_id, pixel, channel, v``: greatest weight times colour; ``colours(label, rgb)`` is looked up."""
    painted = footprint.join(labels.select("roi_id", "label"), "roi_id").join(colours, "label").select("session_id", "pixel", "weight", F.posexplode("rgb").alias("channel", "c"))
    return painted.groupBy("session_id", "pixel", "channel").agg(F.max(F.col("weight") * F.col("c")).alias("v"))


def neuropil(stat: DataFrame) -> DataFrame:
    """``roi_id, pixel``: boolean masks from flat index lists."""
    return stat.select("roi_id", F.explode("neuropil_mask").alias("pixel"))


def scale_factor(um_per_pixel: Column, size: int) -> Column:
    """Resize factor that brings objects of different magnification to one scale."""
    return um_per_pixel * F.lit(1.2 * size / 36)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def compose(a: Column, b: Column) -> Column:
    """Product of two 3x3 matrices held as row-major arrays of nine."""

    def product(p: Column) -> Column:
        x, y = p["a"], p["b"]
        return F.array(*(F.get(x, F.lit(3 * r)) * F.get(y, F.lit(c)) + F.get(x, F.lit(3 * r + 1)) * F.get(y, F.lit(3 + c)) + F.get(x, F.lit(3 * r + 2)) * F.get(y, F.lit(6 + c)) for r in range(3) for c in range(3)))

    return _bound(F.struct(a.alias("a"), b.alias("b")), product)


def invert_warp(m: Column) -> Column:
    """Inverse of a 3x3 matrix; a singular one gives nulls."""

    def cofactors(m: Column) -> Column:
        e = [F.get(m, F.lit(k)) for k in range(9)]

        def cofactor(r: int, c: int) -> Column:
            p, q, s, t = (e[3 * i + j] for i in range(3) for j in range(3) if i != r and j != c)
            return (p * t - q * s) * (-1 if (r + c) % 2 else 1)

        adjugate = F.array(*(cofactor(c, r) for r in range(3) for c in range(3)))
        return F.struct(adjugate.alias("adj"), (e[0] * cofactor(0, 0) + e[1] * cofactor(0, 1) + e[2] * cofactor(0, 2)).alias("det"))

    return _bound(_bound(m, cofactors), lambda p: F.transform(p["adj"], lambda x: F.try_divide(x, p["det"])))


def warp_to_remap(m: Column, y: Column, x: Column) -> Column:
    """Source coordinates of a pixel under a warp matrix, as ``(sy, sx)``."""

    def source(p: Column) -> Column:
        row = lambda r: F.get(p["m"], F.lit(3 * r)) * p["x"] + F.get(p["m"], F.lit(3 * r + 1)) * p["y"] + F.get(p["m"], F.lit(3 * r + 2))
        return F.struct(F.try_divide(row(1), row(2)).alias("sy"), F.try_divide(row(0), row(2)).alias("sx"))

    return _bound(F.struct(m.alias("m"), y.alias("y"), x.alias("x")), source)


def _cubic(d: Column) -> Column:
    d, a = F.abs(d), -0.75
    return F.when(d <= 1, (a + 2) * d**3 - (a + 3) * d**2 + 1).when(d < 2, a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a).otherwise(0.0)


def _lanczos(d: Column) -> Column:
    sinc = lambda x: F.when(x == 0, 1.0).otherwise(F.sin(x * math.pi) / (x * math.pi))
    return F.when(F.abs(d) < 4, sinc(d) * sinc(d / 4)).otherwise(0.0)


#: Places from the one at or before the coordinate, and the weight of a distance.
KERNELS = {"linear": ((0, 1), lambda d: F.greatest(1 - F.abs(d), F.lit(0.0))), "cubic": (range(-1, 3), _cubic), "lanczos": (range(-3, 5), _lanczos)}


def _taps(at: Column, method: str) -> Column:
    """The places on one axis that a coordinate reads, and their weights, which sum to one."""
    if method == "nearest":
        return F.array(F.struct(F.floor(at + 0.5).cast("bigint").alias("n"), F.lit(1.0).alias("k")))
    places, weight = KERNELS[method]
    first = F.floor(at).cast("bigint")
    weights = [weight(at - first - k) for k in places]
    total = functools.reduce(operator.add, weights) if method == "lanczos" else F.lit(1.0)
    return F.array(*(F.struct((first + k).alias("n"), (w / total).alias("k")) for k, w in zip(places, weights, strict=True)))


def _inside(n: Column, size: int, border: str) -> Column:
    """A place on an axis of ``size`` places for any whole number; null outside if the border is constant."""
    if border == "replicate":
        return F.greatest(F.least(n, F.lit(size - 1)), F.lit(0))
    if border == "wrap":
        return F.pmod(n, F.lit(size))
    if border == "reflect":
        turn = F.pmod(n, F.lit(2 * size))
        return F.least(turn, 2 * size - 1 - turn)
    return F.when((n >= 0) & (n < size), n)


def remap_image(image: DataFrame, remap: DataFrame, method: str = "linear", border: str = "constant", value: float = 0.0, frame: tuple[int, int] | None = None) -> DataFrame:
    """``session_id, y, x, v``: the image sampled at ``remap(session_id, y, x, sy, sx)``.

    ``method`` is nearest (halves go up), linear, cubic or lanczos (eight places an axis).
    ``border`` says what lies outside a ``frame`` of (height, width): a constant ``value``, or the
    image replicated, reflected or wrapped. Places inside that the image lacks are 0; without a
    frame so is everything outside. A place with a null or NaN coordinate is left out.

    One equi-join on the places that each source coordinate reads.
    """
    if method != "nearest" and method not in KERNELS:
        raise ValueError(f"no such method: {method}")
    if border not in ("constant", "replicate", "reflect", "wrap"):
        raise ValueError(f"no such border: {border}")
    if frame is None and (border != "constant" or value):
        raise ValueError("a border needs the frame's height and width")
    rows = remap.where("sy IS NOT NULL AND sx IS NOT NULL AND NOT isnan(sy) AND NOT isnan(sx)")
    rows = rows.select("session_id", "y", "x", "sx", F.explode(_taps(F.col("sy"), method)).alias("a"))
    rows = rows.select("session_id", "y", "x", "a", F.explode(_taps(F.col("sx"), method)).alias("b"))
    ny, nx = F.col("a.n"), F.col("b.n")
    if frame is not None:
        ny, nx = _inside(ny, frame[0], border), _inside(nx, frame[1], border)
    wanted = rows.select("session_id", "y", "x", ny.alias("ny"), nx.alias("nx"), (F.col("a.k") * F.col("b.k")).alias("k")).where("k <> 0")
    found = wanted.join(image.select("session_id", F.col("y").alias("ny"), F.col("x").alias("nx"), "v"), ["session_id", "ny", "nx"], "left")
    missing = F.when(F.col("ny").isNull() | F.col("nx").isNull(), F.lit(float(value))).otherwise(0.0)
    return found.groupBy("session_id", "y", "x").agg(F.sum(F.col("k") * F.coalesce("v", missing)).alias("v"))


def remap_bilinear(image: DataFrame, remap: DataFrame) -> DataFrame:
    """``remap_image`` between four neighbours; outside is 0."""
    return remap_image(image, remap)


def flow_to_remap(flow: DataFrame) -> DataFrame:
    return flow.select("session_id", "y", "x", (F.col("y") + F.col("dy")).alias("sy"), (F.col("x") + F.col("dx")).alias("sx"))


def remap_to_flow(remap: DataFrame) -> DataFrame:
    return remap.select("session_id", "y", "x", (F.col("sy") - F.col("y")).alias("dy"), (F.col("sx") - F.col("x")).alias("dx"))


def global_minmax(pixels: DataFrame) -> DataFrame:
    """Values scaled to 0..1 over all sessions' images together (the range is one row)."""
    span = pixels.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return pixels.crossJoin(F.broadcast(span)).withColumn("v", F.coalesce(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))).drop("lo", "hi")


def mix_footprints(fov: DataFrame, footprint: DataFrame, share: float) -> DataFrame:
    """FOV images with their objects drawn in: ``(1 - share) * fov + share**2 * mean(fov) * sum of max-normalised weights``."""
    drawn = footprint.withColumn("w", F.col("weight") / F.greatest(F.max("weight").over(Window.partitionBy("roi_id")), F.lit(S.TINY)))
    drawn = drawn.groupBy("session_id", "pixel").agg(F.sum("w").alias("r"))
    both = fov.join(drawn, ["session_id", "pixel"], "left").crossJoin(F.broadcast(fov.agg(F.avg("v").alias("m"))))
    return both.select("session_id", "pixel", (F.col("v") * (1 - share) + F.coalesce("r", F.lit(0.0)) * F.col("m") * share**2).alias("v"))


def warp_footprints(footprint: DataFrame, remap: DataFrame, width: int) -> DataFrame:
    """Footprints sampled at ``remap(session_id, y, x, sy, sx)``, bilinear, negatives clipped, each summing to one.

    Every object is gathered through its session's remap: an equi-join on source pixels, so
    only pixels that an object touches are looked at.
    """
    fy, fx = F.floor("sy").cast("bigint"), F.floor("sx").cast("bigint")
    wy, wx = F.col("sy") - fy, F.col("sx") - fx
    corners = F.array(*(F.struct(((fy + a) * width + fx + b).alias("source"), ((wy if a else 1 - wy) * (wx if b else 1 - wx)).alias("k"), (fx + b).between(0, width - 1).alias("ok")) for a in (0, 1) for b in (0, 1)))
    wanted = remap.select("session_id", (F.col("y") * width + F.col("x")).alias("to"), F.explode(corners).alias("n")).where("n.k > 0 AND n.ok").select("session_id", "to", F.col("n.source").alias("pixel"), "n.k")
    moved = footprint.join(wanted, ["session_id", "pixel"]).groupBy("roi_id", "session_id", F.col("to").alias("pixel")).agg(F.sum(F.greatest("weight", F.lit(0.0)) * F.col("k")).alias("weight"))
    whole = F.sum("weight").over(Window.partitionBy("roi_id"))
    return moved.withColumn("weight", F.coalesce(F.try_divide(F.col("weight"), whole), F.lit(0.0)))


def shift_remap(spark: SparkSession, shifts: DataFrame, height: int, width: int) -> DataFrame:
    """``remap`` of whole-pixel shifts ``(session_id, dy, dx)`` over a frame."""
    grid = spark.range(height * width).select(F.floor(F.col("id") / width).cast("bigint").alias("y"), (F.col("id") % width).alias("x"))
    return grid.crossJoin(F.broadcast(shifts)).select("session_id", "y", "x", (F.col("y") - F.col("dy")).cast("double").alias("sy"), (F.col("x") - F.col("dx")).cast("double").alias("sx"))


def in_polygon(y: Column, x: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a point is inside a drawn region (``corners`` as (y, x)), by crossing parity."""
    inside = F.lit(False)
    for (ya, xa), (yb, xb) in zip(corners, corners[1:] + corners[:1], strict=True):
        if ya != yb:
            crosses = ((F.lit(ya) > y) != (F.lit(yb) > y)) & (x < F.lit(xa) + (y - F.lit(ya)) * F.lit((xb - xa) / (yb - ya)))
            inside = inside != crosses
    return inside
