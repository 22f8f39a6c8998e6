"""Queries of identities, masks, set operations, sampling and bins."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import calibrate as C
from tessera.operators import filters as L
from tessera.operators import ids
from tessera.plans import sql as Q
from tessera.plans.registry import register
from tessera.sources import harness as H

_FP = Q.with_(Q.FOOTPRINT)
_ROI = Q.with_(Q.ROI)
_UCID = Q.with_(Q.UCID)


def _entries(spark, d):
    return H.footprint(spark, d).select(F.col("roi_id").alias("i"), F.col("pixel").alias("j"), F.col("weight").alias("s"))


def _second(spark, d):
    """A second pattern on the same places: parts a supplier delivered with a discount above 5 %."""
    return H.table(spark, d, "lineitem").where("l_discount > 0.05").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).distinct()


_B = "b AS (SELECT DISTINCT l_suppkey AS i, l_partkey AS j FROM lineitem WHERE l_discount > 0.05)"
_E = "e AS (SELECT roi_id AS i, pixel AS j, weight AS s FROM footprint)"


@register("sparse_mask", Q.with_(Q.FOOTPRINT, _E, _B) + "SELECT e.* FROM e JOIN b USING (i, j)")
def sparse_mask(spark, d):
    return L.sparse_mask(_entries(spark, d), _second(spark, d))


@register("mask_intersection", Q.with_(Q.FOOTPRINT, _E, _B) + "SELECT e.* FROM e JOIN b USING (i, j) WHERE (i, j) IN (SELECT (l_suppkey, l_partkey) FROM lineitem WHERE l_tax < 0.04)")
def mask_intersection(spark, d):
    third = H.table(spark, d, "lineitem").where("l_tax < 0.04").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"))
    return L.sparse_mask(_entries(spark, d), _second(spark, d), third)


@register("pattern_union", Q.with_(_B) + "SELECT i, j FROM b UNION SELECT l_suppkey, l_partkey FROM lineitem WHERE l_tax < 0.02")
def pattern_union(spark, d):
    return L.pattern_union(_second(spark, d), H.table(spark, d, "lineitem").where("l_tax < 0.02").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")))


@register("pattern_intersect", Q.with_(_B) + "SELECT i, j FROM b INTERSECT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_tax < 0.02")
def pattern_intersect(spark, d):
    return L.pattern_intersect(_second(spark, d), H.table(spark, d, "lineitem").where("l_tax < 0.02").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")))


@register("unmatched", "SELECT c_custkey AS roi_id, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def unmatched(spark, d):
    matched = H.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("roi_id"))
    return L.unmatched(H.table(spark, d, "customer").select(F.col("c_custkey").alias("roi_id"), "c_nationkey"), matched)


@register("key_difference", "SELECT c_custkey AS k, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT DISTINCT user_id FROM events) UNION ALL SELECT DISTINCT user_id, 'right' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)")
def key_difference(spark, d):
    return L.key_difference(H.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), H.table(spark, d, "events").select(F.col("user_id").alias("k")), "k")


@register("class_filter", _ROI + "SELECT * FROM roi WHERE label NOT IN (2, 5)")
def class_filter(spark, d):
    return L.by_class(H.roi(spark, d), remove=[2, 5])


@register("mask_ucid_iscell", _UCID + "SELECT session_id, roi_idx, CASE WHEN roi_idx % 3 <> 0 THEN ucid ELSE -1 END AS ucid FROM ucid")
def mask_ucid_iscell(spark, d):
    return ids.mask_by_flag(H.ucid(spark, d).withColumn("iscell", F.col("roi_idx") % 3 != 0)).drop("iscell")


@register("mask_ucid_label", _UCID + "SELECT session_id, roi_idx, CASE WHEN ucid IN (2, 3) THEN ucid ELSE -1 END AS ucid FROM ucid")
def mask_ucid_label(spark, d):
    return ids.mask_by_label(H.ucid(spark, d), [2, 3])


@register("min_sessions", _UCID + "SELECT session_id, roi_idx, CASE WHEN ucid IN (SELECT ucid FROM ucid WHERE ucid >= 0 GROUP BY ucid HAVING count(DISTINCT session_id) >= 8) THEN ucid ELSE -1 END AS ucid FROM ucid")
def min_sessions(spark, d):
    return ids.discard_rare(H.ucid(spark, d), "all")


@register("squeeze_ucids", _UCID + ", u AS (SELECT session_id, roi_idx, CASE WHEN ucid >= 0 THEN ucid * ucid + 3 ELSE -1 END AS v FROM ucid) SELECT session_id, roi_idx, (CASE WHEN v < 0 THEN -1 ELSE dense_rank() OVER (PARTITION BY v >= 0 ORDER BY v) - 1 END)::BIGINT AS ucid FROM u")
def squeeze_ucids(spark, d):
    return ids.squeeze_ucids(H.ucid(spark, d).withColumn("ucid", F.when(F.col("ucid") >= 0, F.col("ucid") * F.col("ucid") + 3).otherwise(F.lit(-1).cast("bigint"))))


@register("min_cluster_size", _ROI + "SELECT roi_id, session_id, cy, cx, CASE WHEN count(*) OVER (PARTITION BY label) >= 50 THEN label ELSE -1 END AS label FROM roi")
def min_cluster_size(spark, d):
    return L.least_cluster_size(H.roi(spark, d), 50)


@register("session_violations", _ROI + "SELECT label, count(*) AS n, count(DISTINCT session_id) AS sessions FROM roi WHERE label >= 0 GROUP BY label HAVING count(*) > count(DISTINCT session_id)")
def session_violations(spark, d):
    return L.session_violations(H.roi(spark, d))


@register("coo_dedup", "SELECT l_suppkey AS i, l_partkey AS j, min(l_orderkey * 10 + l_linenumber) AS pos, arg_min(l_quantity, l_orderkey * 10 + l_linenumber) AS s FROM lineitem GROUP BY ALL")
def coo_dedup(spark, d):
    x = H.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_quantity").alias("s"))
    return L.first_entry(x)


@register("sparse_diff", Q.with_(Q.FOOTPRINT, _E, "f AS (SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS s FROM lineitem WHERE l_linenumber < 6 GROUP BY ALL)") + "SELECT i, j, coalesce(e.s, 0) AS a, coalesce(f.s, 0) AS b FROM e FULL JOIN f USING (i, j) WHERE abs(coalesce(e.s, 0) - coalesce(f.s, 0)) > 1e-8 + abs(coalesce(f.s, 0)) * 1e-5")
def sparse_diff(spark, d):
    other = H.table(spark, d, "lineitem").where("l_linenumber < 6").groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.sum("l_quantity").alias("s"))
    return L.sparse_diff(_entries(spark, d), other)


@register("block_merge_max", "SELECT i, j, max(s) AS s FROM (SELECT l_suppkey AS i, l_partkey AS j, l_quantity AS s FROM lineitem WHERE l_linenumber <= 3 UNION ALL SELECT l_suppkey, l_partkey, l_quantity FROM lineitem WHERE l_linenumber >= 3) GROUP BY ALL")
def block_merge_max(spark, d):
    from tessera.operators.similarity import merge_max

    x = H.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("s"), "l_linenumber")
    return merge_max(x.where("l_linenumber <= 3").unionByName(x.where("l_linenumber >= 3")).drop("l_linenumber"))


@register("merge_first", "SELECT i, j, coalesce(arg_min(s, k)) AS s FROM (SELECT l_suppkey AS i, l_partkey AS j, max(l_tax) AS s, 0 AS k FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL UNION ALL SELECT l_suppkey, l_partkey, max(l_discount), 1 FROM lineitem WHERE l_linenumber >= 3 GROUP BY ALL) GROUP BY ALL HAVING arg_min(s, k) <> 0")
def merge_first(spark, d):
    x = H.table(spark, d, "lineitem")
    part = lambda where, c: x.where(where).groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.max(c).alias("s"))
    return L.merge_first([part("l_linenumber <= 3", "l_tax"), part("l_linenumber >= 3", "l_discount")])


_SPINE = "spine AS (SELECT session_id, u.ucid FROM (SELECT DISTINCT session_id FROM ucid), (SELECT unnest(range((SELECT max(ucid) + 1 FROM ucid))) AS ucid) u), last AS (SELECT session_id, ucid, max(roi_idx) AS roi_idx FROM ucid WHERE ucid >= 0 GROUP BY ALL)"
_VALUES = "vals AS (SELECT (vec_id % 8)::INTEGER AS session_id, vec_id // 8 AS roi_idx, round(embedding[1]::DOUBLE, 6) + 0.0 AS v FROM embeddings)"


def _values(spark, d):
    e = H.table(spark, d, "embeddings")
    return e.select((F.col("vec_id") % 8).cast("int").alias("session_id"), F.floor(F.col("vec_id") / 8).cast("bigint").alias("roi_idx"), (F.round(F.get("embedding", F.lit(0)).cast("double"), 6) + 0.0).alias("v"))


@register("ucid_align", Q.with_(Q.UCID, _SPINE, _VALUES) + "SELECT session_id, ucid, roi_idx, v FROM spine LEFT JOIN last USING (session_id, ucid) LEFT JOIN vals USING (session_id, roi_idx)")
def ucid_align(spark, d):
    return ids.align(H.ucid(spark, d), _values(spark, d)).select("session_id", "ucid", "roi_idx", "v")


@register("ucid_align_inverse", Q.with_(Q.UCID, _SPINE, _VALUES) + "SELECT ucid.session_id, ucid.roi_idx, ucid.ucid, v FROM ucid LEFT JOIN (SELECT session_id, ucid, v FROM spine LEFT JOIN last USING (session_id, ucid) LEFT JOIN vals USING (session_id, roi_idx)) a USING (session_id, ucid)")
def ucid_align_inverse(spark, d):
    labels = H.ucid(spark, d)
    return ids.align_inverse(labels, ids.align(labels, _values(spark, d))).select("session_id", "roi_idx", "ucid", "v")


@register("invert_ucids", Q.with_(Q.UCID, "once AS (SELECT session_id, ucid * (SELECT max(roi_idx) + 1 FROM ucid) + roi_idx AS ucid, roi_idx FROM ucid WHERE ucid >= 0)", "spine AS (SELECT s.session_id, u.ucid FROM (SELECT DISTINCT session_id FROM once) s, (SELECT unnest(range((SELECT max(ucid) + 1 FROM once))) AS ucid) u)") + "SELECT session_id, ucid, coalesce(once.roi_idx, -1) AS roi_idx FROM spine LEFT JOIN once USING (session_id, ucid)")
def invert_ucids(spark, d):
    """Every assigned object, under ids made unique in a session."""
    labels = H.ucid(spark, d)
    stride = labels.agg(F.max("roi_idx")).first()[0] + 1
    return ids.invert(labels.where("ucid >= 0").withColumn("ucid", F.col("ucid") * stride + F.col("roi_idx")))


@register("session_offsets", _ROI + "SELECT session_id, count(*) AS n, (sum(count(*)) OVER (ORDER BY session_id) - count(*))::BIGINT AS first FROM roi GROUP BY session_id")
def session_offsets(spark, d):
    return ids.session_offsets(H.roi(spark, d))


@register("labels_by_session", _UCID + "SELECT session_id, array_to_string(list(ucid ORDER BY roi_idx), ',') AS ucids FROM ucid GROUP BY session_id")
def labels_by_session(spark, d):
    return ids.by_session(H.ucid(spark, d)).select("session_id", F.array_join("ucids", ",").alias("ucids"))


@register("value_counts", _ROI + "SELECT sessions, count(*) AS clusters FROM (SELECT label, count(DISTINCT session_id) AS sessions FROM roi WHERE label >= 0 GROUP BY label) GROUP BY sessions")
def value_counts(spark, d):
    from tessera.operators.quality import coverage

    return coverage(H.roi(spark, d))


@register("union_sessions", "SELECT l_linenumber AS session_id, l_suppkey AS roi_id, l_partkey AS pixel, l_quantity AS weight FROM lineitem")
def union_sessions(spark, d):
    """Each line number's rows are a session; the sessions are put together again."""
    x = H.table(spark, d, "lineitem")
    part = lambda k: x.where(F.col("l_linenumber") == k).select(F.col("l_linenumber").alias("session_id"), F.col("l_suppkey").alias("roi_id"), F.col("l_partkey").alias("pixel"), F.col("l_quantity").alias("weight"))
    parts = [part(r[0]) for r in x.select("l_linenumber").distinct().orderBy("l_linenumber").collect()]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


@register("with_discarded", "SELECT l_orderkey, l_linenumber, (l_returnflag <> 'R')::INTEGER AS overall FROM lineitem")
def with_discarded(spark, d):
    from tessera.sources.files import with_discarded as both

    x = H.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return both(x.where("l_returnflag <> 'R'"), x.where("l_returnflag = 'R'")).drop("l_returnflag")


@register("column_major_reorder", _FP + "SELECT roi_id, (pixel % 50) * 40 + pixel // 50 AS pixel, weight FROM footprint")
def column_major_reorder(spark, d):
    from tessera.sources.files import reorder_columns_first

    return reorder_columns_first(H.footprint(spark, d).select("roi_id", "pixel", "weight"), 50, 40)


_SHARE = "share AS (SELECT o_orderstatus, greatest(floor(count(*) * 300.0 / (SELECT count(*) FROM orders)), 100) AS take FROM orders GROUP BY 1)"


@register("stratified_sample", Q.with_(_SHARE) + "SELECT o_orderkey, o_custkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY (o_orderkey * 7919 + o_custkey * 112648) % 1000003, o_orderkey, o_custkey) AS p FROM orders) JOIN share USING (o_orderstatus) WHERE p <= take")
def stratified_sample(spark, d):
    return L.stratified_sample(H.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderstatus", 300, ("o_orderkey", "o_custkey")).select("o_orderkey", "o_custkey", "o_orderstatus")


@register("stratified_split", "SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY (c_custkey * 7919) % 1000003, c_custkey) <= round(count(*) OVER (PARTITION BY c_mktsegment) * 0.3) AS is_test FROM customer")
def stratified_split(spark, d):
    return L.stratified_split(H.table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey")


@register("some_per_label", "SELECT c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY (c_custkey * 7919) % 1000003, c_custkey) <= 7")
def some_per_label(spark, d):
    return L.some_per_label(H.table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 7)


@register("quantile_ladder", "SELECT k::INTEGER AS step, round(v, 6) AS value FROM (SELECT unnest(range(11)) AS k, unnest(quantile_cont(o_totalprice, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS v FROM orders)")
def quantile_ladder(spark, d):
    return L.quantile_ladder(H.table(spark, d, "orders"), "o_totalprice", 11).select("step", F.round("value", 6).alias("value"))


@register("batch_index", "SELECT o_orderkey, o_orderkey // 256 AS batch FROM orders WHERE o_orderkey // 256 IN (SELECT o_orderkey // 256 FROM orders GROUP BY 1 HAVING count(*) >= 200)")
def batch_index(spark, d):
    return L.batches(H.table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 256, 200)


@register("make_smaller", Q.with_(Q.FOOTPRINT, "kept AS (SELECT roi_id, session_id FROM (SELECT DISTINCT roi_id, session_id FROM footprint) WHERE session_id < 4 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY roi_id) <= 5)") + "SELECT f.roi_id, f.session_id, f.pixel, f.weight FROM footprint f JOIN kept USING (roi_id) WHERE f.pixel // 40 >= 5 AND f.pixel // 40 < 30 AND f.pixel % 40 >= 2 AND f.pixel % 40 < 33")
def make_smaller(spark, d):
    f = H.footprint(spark, d)
    inside, _ = L.make_smaller(f, f.select("roi_id", "session_id").distinct(), 5, 4, 40, (5, 30), (2, 33))
    return inside.select("roi_id", "session_id", "pixel", "weight")


_BIN = "CASE WHEN l_quantity = 50 THEN 19 ELSE floor((l_quantity - 0.0) / 50 * 20) END::INTEGER"


@register("fixed_histogram", f"SELECT k::INTEGER AS bin, coalesce(n, 0) AS n FROM range(20) t(k) LEFT JOIN (SELECT {_BIN} AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1) ON bin = k")
def fixed_histogram(spark, d):
    return C.histogram(H.table(spark, d, "lineitem"), "l_quantity", 0.0, 50.0, 20)


@register("boxcar_smooth", f"SELECT bin, n, round(avg(n) OVER (ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM (SELECT k::INTEGER AS bin, coalesce(n, 0) AS n FROM range(20) t(k) LEFT JOIN (SELECT {_BIN} AS bin, count(*) AS n FROM lineitem GROUP BY 1) ON bin = k)")
def boxcar_smooth(spark, d):
    return C.boxcar(C.histogram(H.table(spark, d, "lineitem"), "l_quantity", 0.0, 50.0, 20), "n", 5, "smooth").select("bin", "n", F.round("smooth", 6).alias("smooth"))


@register("running_best", "SELECT o_orderkey, best, max(best) OVER r - min(best) OVER r AS span FROM (SELECT o_orderkey, min(o_totalprice) OVER (ORDER BY o_orderkey) AS best FROM orders) WINDOW r AS (ORDER BY o_orderkey ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def running_best(spark, d):
    """All orders as trials."""
    trials = H.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return C.running_best_whole(trials, "o_orderkey", "o_totalprice", 20).select("o_orderkey", "best", "span")


@register("lag_diff", "SELECT o_custkey, o_orderkey, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS diff FROM orders")
def lag_diff(spark, d):
    return C.neighbour_difference(H.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey", "o_totalprice").drop("o_totalprice")


@register("warp_chain", "SELECT s_nationkey AS session_id, sum(dy) OVER (ORDER BY s_nationkey)::BIGINT AS dy FROM (SELECT s_nationkey, count(*) AS dy FROM supplier GROUP BY 1)")
def warp_chain(spark, d):
    from tessera.operators.align import chain

    per = H.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("session_id")).agg(F.count("*").alias("dy")).withColumn("dx", F.lit(0))
    return chain(per).select("session_id", "dy")


@register("trace_align", Q.with_(Q.UCID, _SPINE, Q.TRACE, "tr AS (SELECT session_id, roi_idx, count(*) AS days, round(sum(value), 4) AS total FROM trace GROUP BY ALL)") + "SELECT session_id, ucid, roi_idx, days, total FROM spine LEFT JOIN last USING (session_id, ucid) LEFT JOIN tr USING (session_id, roi_idx)")
def trace_align(spark, d):
    per = H.trace(spark, d).groupBy("session_id", "roi_idx").agg(F.count("*").alias("days"), F.round(F.sum("value"), 4).alias("total"))
    return ids.align(H.ucid(spark, d), per).select("session_id", "ucid", "roi_idx", "days", "total")


@register("top_two_ratio", "SELECT o_custkey, first, second, round(second / first, 6) AS ratio FROM (SELECT o_custkey, o_totalprice AS first, lead(o_totalprice) OVER w AS second, row_number() OVER w AS k FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)) WHERE k = 1")
def top_two_ratio(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    ranked = H.table(spark, d, "orders").select("o_custkey", F.col("o_totalprice").alias("first"), F.lead("o_totalprice").over(w).alias("second"), F.row_number().over(w).alias("k"))
    return ranked.where("k = 1").select("o_custkey", "first", "second", F.round(F.col("second") / F.col("first"), 6).alias("ratio"))


@register("last_occurrence", _UCID + "SELECT session_id, ucid, max(roi_idx) AS roi_idx FROM ucid WHERE ucid >= 0 GROUP BY ALL")
def last_occurrence(spark, d):
    return ids.last_per_session(H.ucid(spark, d))
