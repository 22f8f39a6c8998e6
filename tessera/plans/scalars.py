"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators import ids
from tessera.plans import sql as Q
from tessera.plans.registry import register
from tessera.sources import harness as H


@register("l2_normalize", Q.with_(Q.NN) + "SELECT roi_id, round(vec[1] / n, 6) + 0.0 AS first, round(vec[32] / n, 6) + 0.0 AS last FROM (SELECT *, sqrt(list_dot_product(vec, vec)) AS n FROM nn)")
def l2_normalize(spark, d):
    v = H.latent(spark, d, "nn").select("roi_id", S.l2_normalize(F.col("vec")).alias("u"))
    return v.select("roi_id", (F.round(F.get("u", F.lit(0)), 6) + 0.0).alias("first"), (F.round(F.get("u", F.lit(31)), 6) + 0.0).alias("last"))


@register("logistic_activation", "SELECT o_orderkey, round(pow(greatest(1 / (1 + exp(-2.5 * (o_totalprice / 100000 - 1.5))), 0), 1.7), 6) AS v FROM orders")
def logistic_activation(spark, d):
    return H.table(spark, d, "orders").select("o_orderkey", F.round(S.activation(F.col("o_totalprice") / 100000, mu=1.5, b=2.5, power=1.7), 6).alias("v"))


@register(
    "pnorm_mix",
    """SELECT l_orderkey, l_linenumber, round(sim, 6) AS sim, round(1 - sim, 6) AS d FROM (
      SELECT *, CASE WHEN a = 0 OR b = 0 THEN 0 ELSE pow((pow(a, -2) + pow(b, -2)) / 2, -0.5) END AS sim
      FROM (SELECT l_orderkey, l_linenumber, greatest(l_discount, 0) AS a, pow(greatest(l_tax, 0), 0.5) AS b FROM lineitem))""",
)
def pnorm_mix(spark, d):
    from tessera.operators.calibrate import conjunctive

    e = H.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return conjunctive(e, {"l_discount": {}, "l_tax": {"power": 0.5}}, -2.0).select("l_orderkey", "l_linenumber", F.round("sim", 6).alias("sim"), F.round("d", 6).alias("d"))


@register("squeeze_integers", "SELECT c_custkey, c_nationkey * 7 - 3 AS v, (dense_rank() OVER (ORDER BY c_nationkey) - 1 + min(c_nationkey * 7 - 3) OVER ())::BIGINT AS squeezed FROM customer")
def squeeze_integers(spark, d):
    return S.squeeze_integers(H.table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") * 7 - 3).alias("v")), "v").select("c_custkey", "v", "squeezed")


@register("one_hot", "SELECT c_custkey, (c_nationkey % 5 = 0)::INTEGER AS k0, (c_nationkey % 5 = 3)::INTEGER AS k3 FROM customer")
def one_hot(spark, d):
    hot = S.one_hot(F.col("c_nationkey") % 5, 5)
    return H.table(spark, d, "customer").select("c_custkey", F.get(hot, F.lit(0)).cast("int").alias("k0"), F.get(hot, F.lit(3)).cast("int").alias("k3"))


@register("digits_from_string", "SELECT c_custkey, nullif(regexp_replace(c_name, '[^0-9]', '', 'g'), '')::BIGINT AS digits FROM customer")
def digits_from_string(spark, d):
    return H.table(spark, d, "customer").select("c_custkey", S.digits(F.col("c_name")).alias("digits"))


@register("class_weights", "SELECT c_mktsegment AS label, count(*) AS n, round((SELECT count(*) FROM customer) / count(*), 6) AS weight FROM customer GROUP BY 1")
def class_weights(spark, d):
    return S.class_weights(H.table(spark, d, "customer").select(F.col("c_mktsegment").alias("label")), "label").select("label", "n", F.round("weight", 6).alias("weight"))


@register("sample_weights", "SELECT c_custkey, round((SELECT count(*) FROM customer) / count(*) OVER (PARTITION BY c_mktsegment), 6) AS weight FROM customer")
def sample_weights(spark, d):
    return S.sample_weights(H.table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment").select("c_custkey", F.round("weight", 6).alias("weight"))


_GRID = "SELECT y::INTEGER AS y, x::INTEGER AS x, {} FROM range({}) a(y), range({}) b(x)"


@register("distance_grid", _GRID.format("round(sqrt(pow(y - 11.5, 2) + pow(x - 15.5, 2)), 6) AS d", 24, 32))
def distance_grid(spark, d):
    return S.distance_grid(spark, 24, 32).select("y", "x", F.round("d", 6).alias("d"))


@register("cosine_kernel", _GRID.format("round((cos(least(sqrt(pow(y - 5, 2) + pow(x - 5, 2)) / 2.5 * pi(), pi())) + 1) / 2, 6) + 0.0 AS v", 11, 11))
def cosine_kernel(spark, d):
    return S.cosine_kernel(spark).select("y", "x", (F.round("v", 6) + 0.0).alias("v"))


@register("flat_index", "SELECT roi_id, cy * 512 + cx AS pixel, (cy * 512 + cx) // 100 AS y, (cy * 512 + cx) % 100 AS x FROM (" + Q.with_(Q.ROI) + "SELECT * FROM roi)")
def flat_index(spark, d):
    y, x = S.reshape(F.col("cy"), F.col("cx"), 512, 100)
    return H.roi(spark, d).select("roi_id", S.flat_index(F.col("cy"), F.col("cx"), 512).alias("pixel"), y.alias("y"), x.alias("x"))


@register("minmax_scale", Q.with_(Q.NN) + "SELECT roi_id, round((vec[1] - list_min(vec)) / (list_max(vec) - list_min(vec) + 1e-9), 6) AS first, round((vec[17] - list_min(vec)) / (list_max(vec) - list_min(vec) + 1e-9), 6) AS mid FROM nn")
def minmax_scale(spark, d):
    v = H.latent(spark, d, "nn").select("roi_id", S.minmax_scale(F.col("vec")).alias("u"))
    return v.select("roi_id", F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(F.get("u", F.lit(16)), 6).alias("mid"))


@register("scale_image_sum", Q.with_(Q.NN) + "SELECT roi_id, round((vec[1] - list_min(vec)) * 2.0 / (list_sum(vec) - 32 * list_min(vec) + 1e-9), 6) AS first FROM nn")
def scale_image_sum(spark, d):
    return H.latent(spark, d, "nn").select("roi_id", F.round(F.get(S.scale_sum(F.col("vec"), 2.0), F.lit(0)), 6).alias("first"))


@register("clip_and_standardise", Q.with_(Q.NN) + "SELECT roi_id, round((least(greatest(vec[2], -0.1), 0.1) - 0.01) / 0.5, 6) + 0.0 AS v FROM nn")
def clip_and_standardise(spark, d):
    u = S.standardise(S.clip_image(F.col("vec"), -0.1, 0.1), 0.01, 0.5)
    return H.latent(spark, d, "nn").select("roi_id", (F.round(F.get(u, F.lit(1)), 6) + 0.0).alias("v"))


@register("image_flags", Q.with_(Q.NN) + "SELECT roi_id, roi_id % 5 = 0 AS has_nan, roi_id % 7 = 0 AS has_inf, (roi_id % 3 = 0 OR (list_max(vec) = 0 AND list_min(vec) = 0)) AND roi_id % 5 <> 0 AND roi_id % 7 <> 0 AS all_zero FROM nn")
def image_flags(spark, d):
    """Every fifth image has a NaN, every seventh an infinite value, every third is else zero."""
    k = F.col("roi_id")
    bad = lambda x, i: F.when((k % 5 == 0) & (i == 3), float("nan")).when((k % 7 == 0) & (i == 4), F.when(k % 2 == 0, float("inf")).otherwise(float("-inf"))).when(k % 3 == 0, 0.0).otherwise(x)
    return H.latent(spark, d, "nn").select("roi_id", S.image_flags(F.transform("vec", bad)).alias("f")).select("roi_id", "f.*")


@register("odd_even", "SELECT p_partkey, p_size + (p_size % 2 = 0)::INTEGER AS odd, p_size - (p_size % 2 <> 0)::INTEGER AS even FROM part")
def odd_even(spark, d):
    return H.table(spark, d, "part").select("p_partkey", S.make_odd(F.col("p_size")).alias("odd"), S.make_even(F.col("p_size"), up=False).alias("even"))


@register("log_spacing", "SELECT k::INTEGER AS k, round(exp(ln(0.5) + (ln(200) - ln(0.5)) * k / 24), 6) AS v FROM range(25) t(k)")
def log_spacing(spark, d):
    return spark.range(1).select(F.posexplode(S.log_spaced(0.5, 200.0, 25)).alias("k", "v")).select("k", F.round("v", 6).alias("v"))


@register("zscore_pvalue", """SELECT l_orderkey, l_linenumber, round(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(31), lambda n: pow(-1, n) * pow(z / sqrt(2), 2 * n + 1) / (factorial(n::INTEGER) * (2 * n + 1)))), 6) AS p, round(z, 4) AS z FROM (
  SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) / 10 AS z FROM lineitem)""")
def zscore_pvalue(spark, d):
    z = (F.col("l_quantity") - 25) / 10
    return H.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.zscore_to_pvalue(z), 6).alias("p"), F.round(S.pvalue_to_zscore(S.zscore_to_pvalue(z)), 4).alias("z"))


@register("class_index", "SELECT p_partkey, p_brand, (dense_rank() OVER (ORDER BY p_brand) - 1)::INTEGER AS class_index FROM part")
def class_index(spark, d):
    return ids.factorize(H.table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand")


@register("class_position", "SELECT p_partkey, p_size, list_position([1, 5, 9], p_size) - 1 AS class_position FROM part WHERE p_size IN (1, 5, 9)")
def class_position(spark, d):
    return ids.lookup_class(H.table(spark, d, "part").where("p_size IN (1, 5, 9)").select("p_partkey", "p_size"), [1, 5, 9], "p_size")


@register("index_with_nulls", "SELECT o_orderkey AS pos, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS idx, CASE WHEN o_custkey % 3 <> 0 THEN c_acctbal END AS v FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def index_with_nulls(spark, d):
    values = H.table(spark, d, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_acctbal").alias("v"))
    return ids.index_with_nulls(values, H.table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("idx")))
