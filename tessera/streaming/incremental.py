"""Sessions as a stream: each micro-batch of edges of a new session extends the running union.

The reference behaviour is the batch operator ``sequential_assignment``; this is its natural
incremental form. State is a table in a folder; a batch that is run again after a failure
finds its own version of the state and writes it again, so results do not depend on retries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.graph import assign_step, next_union

STATE = "track long, roi_id long"


class Tracker:
    """State versions ``<root>/v<batch>``; version -1 is empty."""

    def __init__(self, spark: SparkSession, root: str, thresh: float = 0.95):
        self.spark, self.root, self.thresh = spark, root, thresh

    def union(self, version: int) -> DataFrame:
        if version < 0:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(f"{self.root}/v{version}")

    def advance(self, edges: DataFrame, version: int) -> None:
        """``edges(i, j, d)``: ``i`` of the new session; a row with null ``j`` only announces an object."""
        before = self.union(version - 1)
        mine = edges.select(F.col("i").alias("roi_id")).distinct()
        cost = edges.where("j IS NOT NULL").join(before.select(F.col("roi_id").alias("j")), "j", "left_semi").select(F.col("i").alias("left"), F.col("j").alias("right"), "d")
        next_union(before, mine, assign_step(cost, self.thresh)).write.mode("overwrite").parquet(f"{self.root}/v{version}")


def track_stream(edges: DataFrame, root: str, checkpoint: str, thresh: float = 0.95) -> StreamingQuery:
    """Start tracking on a stream of edges, a session per micro-batch."""
    tracker = Tracker(edges.sparkSession, root, thresh)
    return edges.writeStream.foreachBatch(lambda batch, k: tracker.advance(batch, k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
