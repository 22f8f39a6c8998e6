"""Cluster identities (UCIDs): relabel, mask, filter, align and invert. -1 is unassigned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.order import numbered


def squeeze_ucids(labels: DataFrame, column: str = "ucid") -> DataFrame:
    """Assigned ids become 0, 1, 2 ... in their order; -1 stays. The distinct ids are numbered by ranges."""
    dense = numbered(labels.select(column).where(F.col(column) >= 0).distinct(), column, out="__new")
    return labels.join(dense, column, "left").withColumn(column, F.coalesce("__new", F.lit(-1).cast("bigint"))).select(*labels.columns)


def mask_by_flag(labels: DataFrame, flag: str = "iscell") -> DataFrame:
    return labels.withColumn("ucid", F.when(F.col(flag), F.col("ucid")).otherwise(F.lit(-1).cast("bigint")))


def mask_by_label(labels: DataFrame, keep: list[int]) -> DataFrame:
    """Ids outside ``keep`` become -1. The keep list comes from the caller, so it is a literal set."""
    return labels.withColumn("ucid", F.when(F.col("ucid").isin(keep), F.col("ucid")).otherwise(F.lit(-1).cast("bigint")))


def discard_rare(labels: DataFrame, least: int | str = "all") -> DataFrame:
    """Ids seen in fewer than ``least`` sessions (``all``: in every session) become -1."""
    n = labels.select(F.countDistinct("session_id")).first()[0] if least == "all" else least
    common = labels.where("ucid >= 0").groupBy("ucid").agg(F.countDistinct("session_id").alias("__n")).where(F.col("__n") >= n).select("ucid", F.lit(True).alias("__keep"))
    return labels.join(common, "ucid", "left").withColumn("ucid", F.when(F.col("__keep"), F.col("ucid")).otherwise(F.lit(-1).cast("bigint"))).select(*labels.columns)


def last_per_session(labels: DataFrame) -> DataFrame:
    """One row per session and assigned id, the last object if several hold it."""
    return labels.where("ucid >= 0").groupBy("session_id", "ucid").agg(F.max("roi_idx").alias("roi_idx"))


def spine(labels: DataFrame) -> DataFrame:
    """Every session with every id from 0 to the greatest, generated, not collected."""
    top = labels.agg(F.max("ucid").alias("__top"))
    sessions = labels.select("session_id").distinct()
    return sessions.crossJoin(F.broadcast(top)).where("__top >= 0").select("session_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__top").cast("bigint"))).alias("ucid"))


def align(labels: DataFrame, values: DataFrame) -> DataFrame:
    """``values(session_id, roi_idx, ...)`` laid out by id: a row per session and id, nulls where absent."""
    found = last_per_session(labels).join(values, ["session_id", "roi_idx"], "left")
    return spine(labels).join(found, ["session_id", "ucid"], "left")


def align_inverse(labels: DataFrame, aligned: DataFrame) -> DataFrame:
    """Back from ids to objects: each assigned object gets its id's row, others nulls."""
    return labels.join(aligned.drop("roi_idx") if "roi_idx" in aligned.columns else aligned, ["session_id", "ucid"], "left")


def invert(labels: DataFrame) -> DataFrame:
    """``session_id, ucid, roi_idx``: -1 where a session lacks an id; a repeated id in a session is an error."""
    once = labels.where("ucid >= 0").groupBy("session_id", "ucid").agg(F.count("*").alias("n"), F.max("roi_idx").alias("roi_idx"))
    checked = once.select("session_id", "ucid", F.when(F.col("n") == 1, F.col("roi_idx")).otherwise(F.raise_error(F.lit("an id occurs twice in a session")).cast("bigint")).alias("roi_idx"))
    return spine(labels).join(checked, ["session_id", "ucid"], "left").withColumn("roi_idx", F.coalesce("roi_idx", F.lit(-1).cast("bigint")))


def index_with_nulls(values: DataFrame, indices: DataFrame) -> DataFrame:
    """``values(idx, v)`` looked up by ``indices(pos, idx)``; a null index gives null."""
    return indices.join(values, "idx", "left").select("pos", "idx", "v")


def by_session(labels: DataFrame) -> DataFrame:
    """``session_id, ucids``: a session's ids in the objects' order."""
    return labels.groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("roi_idx", "ucid"))), lambda t: t["ucid"]).alias("ucids"))


def by_label(labels: DataFrame) -> DataFrame:
    """``ucid, n, sessions``: members of each id; long form stays in ``labels``."""
    return labels.groupBy("ucid").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"))


def session_offsets(labels: DataFrame) -> DataFrame:
    """``session_id, n, first``: objects per session and the running number before it."""
    n = labels.groupBy("session_id").agg(F.count("*").alias("n"))
    return n.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("session_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def factorize(rows: DataFrame, column: str, out: str = "class_index") -> DataFrame:
    """Class labels as 0, 1, 2 ... in lexicographic order, over all sessions together."""
    ranked = numbered(rows.select(F.col(column).cast("string").alias("__c")).distinct(), "__c", out=out, kind="int")
    return rows.withColumn("__c", F.col(column).cast("string")).join(ranked, "__c", "left").drop("__c")


def lookup_class(rows: DataFrame, classes: list, column: str = "label", out: str = "class_position") -> DataFrame:
    """A label's place in the model's class list; a label outside it is an error."""
    places = F.create_map(*(x for k, c in enumerate(classes) for x in (F.lit(c), F.lit(k))))
    found = F.try_element_at(places, F.col(column))
    return rows.withColumn(out, F.when(F.col(column).isNull() | found.isNull(), F.raise_error(F.concat(F.lit("unknown class "), F.coalesce(F.col(column).cast("string"), F.lit("null")))).cast("int")).otherwise(found))
