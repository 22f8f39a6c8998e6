"""Cutting the lineage of iterative plans in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; a folder of our own only where none is set and the master is local."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    given = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not given and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(given or f"file://{tempfile.mkdtemp(prefix='tessera-checkpoint-')}")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    ensure_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(rows: DataFrame) -> DataFrame:
    ensure_dir(rows.sparkSession)
    return rows.checkpoint()


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` written as Parquet in the shared folder and read again: for many narrow rows, a fraction of a checkpoint's size."""
    path = f"{shared_folder(rows.sparkSession)}/stored-{uuid.uuid4().hex[:12]}"
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)
