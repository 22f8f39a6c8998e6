"""Numbering and picking rows in an order without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.checkpoints import cut


def numbered(rows: DataFrame, *by, out: str = "place", kind: str = "bigint") -> DataFrame:
    """``rows`` with their 0-based place in the order of ``by``, over the whole table.

    Rows are dealt by ranges of the order and numbered within each; the driver adds up one
    count a range. Rows equal in ``by`` are in one range, so ``by`` should end in a key.
    """
    kept = cut(rows.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()))
    before, counts = 0, []
    for part, n in kept.groupBy("__range").count().orderBy("__range").collect():
        counts.append((part, before))
        before += n
    ahead = rows.sparkSession.createDataFrame(counts, "__range int, __ahead long")
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*by)) - 1
    return kept.withColumn("__own", own).join(F.broadcast(ahead), "__range").withColumn(out, (F.col("__own") + F.col("__ahead")).cast(kind)).drop("__range", "__own", "__ahead")


def placed_in_strata(rows: DataFrame, stratum: str, by, keys: tuple[str, ...], cells: int, width: int) -> DataFrame:
    """``rows`` with ``__place`` (from 1) in the order of ``by`` and ``keys`` in their stratum, and the stratum's ``__size``.

    ``by`` is a whole number below ``cells * width``. Counts of ``cells`` ranges of it per
    stratum are one aggregate with map-side sums; rows are ranked within their range only,
    so a stratum that holds most rows is still many tasks' work.
    """
    marked = rows.withColumn("__by", by).withColumn("__cell", F.floor(F.col("__by") / width).cast("int"))
    counts = marked.groupBy(stratum, "__cell").agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(stratum)
    ahead = counts.withColumns({"__ahead": F.coalesce(F.sum("__n").over(whole.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__size": F.sum("__n").over(whole)}).drop("__n")
    own = F.row_number().over(Window.partitionBy(stratum, "__cell").orderBy("__by", *keys))
    found = marked.withColumn("__own", own).join(ahead.withColumnRenamed(stratum, "__stratum"), F.col(stratum).eqNullSafe(F.col("__stratum")) & (marked["__cell"] == ahead["__cell"]))
    return found.withColumn("__place", F.col("__own") + F.col("__ahead")).drop(marked["__cell"]).drop("__cell", "__stratum", "__own", "__ahead", "__by")


def running_total(rows: DataFrame, place: str, column: str, out: str, size: int = 100_000) -> DataFrame:
    """``rows`` with the sum of ``column`` up to and including each, in the order of a dense ``place``; by blocks of ``size``."""
    blocks = rows.withColumn("__block", F.floor(F.col(place) / size))
    ahead = blocks.groupBy("__block").agg(F.sum(column).alias("__sum"))
    before = ahead.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    own = F.sum(column).over(Window.partitionBy("__block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("__own", own).join(before, "__block").withColumn(out, F.col("__own") + F.col("__before")).drop("__block", "__own", "__before")
