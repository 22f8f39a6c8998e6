"""Readers, writers and archives: listings, hashes, JSON, CSV labels, composite archives, recordings."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARCHIVE_VERSION = 1


def find_paths(spark: SparkSession, root: str, pattern: str, depth: int | None = None, natural: bool = True) -> DataFrame:
    """``path, length``: files below ``root`` whose name matches, at most ``depth`` folders down, in natural order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    below = F.expr(f"substring(path, {len(root.rstrip('/')) + 1})") if root.startswith("file:") else F.regexp_replace("path", f"^file:/*{root.strip('/')}/", "/")
    found = files.where(F.element_at(F.split("path", "/"), -1).rlike(pattern))
    if depth is not None:
        found = found.where(F.size(F.split(F.regexp_replace(below, "^/", ""), "/")) - 1 <= depth)
    return found.orderBy(natural_key(F.col("path")), "path") if natural else found


def natural_key(text: Column) -> Column:
    """Sort key in which runs of digits compare as numbers."""
    padded = F.regexp_replace(text, r"(\d+)", "000000000000000000$1")
    return F.regexp_replace(padded, r"0*(\d{18})(?!\d)", "$1")


def file_hashes(spark: SparkSession, root: str) -> DataFrame:
    """``path, md5, sha256`` of every file below ``root``."""
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return content.select("path", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def compare_hashes(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Paths that are missing on a side or differ; both tables ``path, sha256``."""
    both = found.select("path", F.col("sha256").alias("a")).join(expected.select("path", F.col("sha256").alias("b")), "path", "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b")))


def write_labels(labels: DataFrame, path: str) -> None:
    """``image_index, label`` as CSV with a header."""
    labels.select("image_index", "label").write.mode("overwrite").option("header", True).csv(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("image_index long, label string").option("header", True).csv(path)


class Archive:
    """A folder of Parquet tables and a manifest; each table is read on its own, columns on demand."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, tables: dict[str, DataFrame], params: dict | None = None) -> None:
        for name, rows in tables.items():
            rows.write.mode("errorifexists").parquet(f"{self.root}/{name}")
        manifest = {"version": ARCHIVE_VERSION, "tables": {n: json.loads(t.schema.json()) for n, t in sorted(tables.items())}, "params": params or {}}
        self.spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{self.root}/manifest")

    def manifest(self) -> dict:
        found = json.loads(self.spark.read.text(f"{self.root}/manifest").first()[0])
        if found["version"] != ARCHIVE_VERSION:
            raise ValueError("unknown archive version")
        return found

    def __getitem__(self, name: str) -> DataFrame:
        tables = self.manifest()["tables"]
        if name not in tables:
            raise KeyError(name)
        return self.spark.read.schema(T.StructType.fromJson(tables[name])).parquet(f"{self.root}/{name}")

    def export(self, path: str) -> int:
        """All files of the archive in one zip on the driver's disk, a file in memory at a time; how many they are."""
        root = qualified(self.spark, self.root)
        rows = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.root).select("path", "content").orderBy("path")
        n = 0
        with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
            for row in rows.toLocalIterator():
                z.writestr(zipfile.ZipInfo(row["path"].removeprefix(root).lstrip("/")), bytes(row["content"]))
                n += 1
        return n

    @classmethod
    def imported(cls, spark: SparkSession, path: str, root: str) -> Archive:
        """An exported archive, unpacked below ``root``, which must be new."""
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            raise FileExistsError(root)
        with zipfile.ZipFile(path) as z:
            for name in z.namelist():
                if name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"a member lies outside the archive: {name}")
                write_bytes(spark, f"{root.rstrip('/')}/{name}", z.read(name))
        return cls(spark, root)


STAT = "session_id int, roi_idx long, ypix array<int>, xpix array<int>, lam array<double>, neuropil_mask array<int>"


def qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark's readers report it: whole, with the file system in front."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A file of these bytes, wherever Spark can write."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def write_stat(spark: SparkSession, path: str, records: list[dict]) -> None:
    """Segmentation records of one session as a NumPy file, wherever Spark can write."""
    content = io.BytesIO()
    np.save(content, np.array(records, object), allow_pickle=True)
    write_bytes(spark, path, content.getvalue())


def read_stat(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Segmentation records of NumPy ``stat`` files, one file per session in the given order.

    Files hold pickled records; read only files you trust.
    """
    order = {qualified(spark, p): k for k, p in enumerate(paths)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                session = order[r.path]
                for k, s in enumerate(np.load(io.BytesIO(r.content), allow_pickle=True)):
                    rows.append((session, k, np.asarray(s["ypix"], np.int32).tolist(), np.asarray(s["xpix"], np.int32).tolist(), np.asarray(s["lam"], float).tolist(), np.asarray(s.get("neuropil_mask", []), np.int32).tolist()))
            yield pd.DataFrame(rows, columns=["session_id", "roi_idx", "ypix", "xpix", "lam", "neuropil_mask"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, STAT)


def stat_to_footprint(stat: DataFrame, width: int, shifts: DataFrame | None = None, normalize: bool = True) -> DataFrame:
    """``session_id, roi_idx, pixel, weight``; weights over their sum, coordinates moved by ``shifts(session_id, dy, dx)``."""
    if shifts is None:
        s = stat.withColumns({"dy": F.lit(0), "dx": F.lit(0)})
    else:
        s = stat.join(F.broadcast(shifts), "session_id")  # one row a session
    total = F.aggregate("lam", F.lit(0.0), lambda a, x: a + x)
    each = s.select("session_id", "roi_idx", "dy", "dx", total.alias("total"), F.explode(F.arrays_zip("ypix", "xpix", "lam")).alias("p"))
    weight = F.try_divide(F.col("p.lam"), F.col("total")) if normalize else F.col("p.lam")
    pixel = (F.col("p.ypix") + F.col("dy")).cast("bigint") * width + F.col("p.xpix") + F.col("dx")
    return each.select("session_id", "roi_idx", pixel.alias("pixel"), weight.alias("weight")).groupBy("session_id", "roi_idx", "pixel").agg(F.sum("weight").alias("weight"))


def reorder_columns_first(footprint: DataFrame, height: int, width: int) -> DataFrame:
    """Pixels counted down the columns, as numbers along the rows."""
    return footprint.withColumn("pixel", (F.col("pixel") % height) * width + F.floor(F.col("pixel") / height).cast("bigint"))


def with_discarded(kept: DataFrame, discarded: DataFrame) -> DataFrame:
    """Kept and discarded components in one table, with the overall label (1 kept, 0 discarded)."""
    return kept.withColumn("overall", F.lit(1)).unionByName(discarded.withColumn("overall", F.lit(0)))


def number_objects(roi: DataFrame) -> DataFrame:
    """``roi_id`` as session offset plus place within the session; offsets are one row a session."""
    from tessera.operators.ids import session_offsets

    return roi.join(F.broadcast(session_offsets(roi).select("session_id", "first")), "session_id").withColumn("roi_id", F.col("first") + F.col("roi_idx")).drop("first")


def completeness(tables: dict[str, DataFrame]) -> dict[str, bool]:
    """Which pipelines the given tables can feed."""
    has = lambda *names: all(n in tables for n in names)
    base = has("roi_image") and has("session")
    labels = has("roi") and "class_idx" in tables["roi"].columns if has("roi") else False
    return {"classification_inference": base, "classification_training": base and labels, "tracking": base and has("footprint", "fov")}


def sha256_file(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()
