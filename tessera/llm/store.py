"""Written intermediate tables in the folder that the whole cluster shares.

A table written here cuts the lineage: whatever is lost later is read again from
the shared folder, not computed again.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only if none is set and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = at.get() if at.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


class Workspace:
    """Tables of one operator call, below one folder of their own.

    The call's result reads some of them, so they stay until ``drop``, or ``close`` once the
    result has been written, or until the cluster clears its checkpoint folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def put(self, table: str, rows: DataFrame) -> DataFrame:
        """Write ``rows`` and read them back."""
        path = f"{self.root}/{table}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(_nullable(rows.schema)).parquet(path)

    def drop(self, table: str) -> None:
        """Delete a table that nothing reads any more."""
        self._delete(f"{self.root}/{table}")

    def close(self) -> None:
        """Delete all tables."""
        self._delete(self.root)

    def _delete(self, at: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few(rows: DataFrame, limit: int, size: Column | None = None, most_bytes: int = 64 << 20) -> bool:
    """Whether ``rows`` has at most ``limit`` rows, and at most ``most_bytes`` in all by ``size``, the bytes of a row.

    One aggregate over a written table; fixed-width rows need no ``size``.
    """
    n, total = rows.agg(F.count("*"), F.sum(F.lit(0) if size is None else size)).first()
    return n <= limit and (total or 0) <= most_bytes
