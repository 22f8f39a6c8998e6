"""In-memory sources: per-session arrays, sparse matrices in parts, dictionaries, extractor objects."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def roi_images(spark: SparkSession, images: Sequence[np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """``roi(roi_id, session_id, roi_idx)`` and ``roi_image(roi_id, img)`` from one ``(n, h, w)`` array per session; all of one size."""
    shapes = {i.shape[1:] for i in images}
    if len(shapes) > 1:
        raise ValueError("images of all sessions must have one size")
    rois, rows, at = [], [], 0
    for s, stack in enumerate(images):
        for k, image in enumerate(stack):
            rois.append((at, s, k))
            rows.append((at, np.asarray(image, float).ravel().tolist()))
            at += 1
    return spark.createDataFrame(rois, "roi_id long, session_id int, roi_idx long"), spark.createDataFrame(rows, "roi_id long, img array<double>")


def footprints(spark: SparkSession, sessions: Sequence[Any], first_id: int = 0) -> DataFrame:
    """``roi_id, session_id, pixel, weight`` from dense ``(n, h, w)`` arrays or row-compressed parts per session.

    Parts are mappings with ``data, indices, indptr`` (an object with these attributes will do).
    """
    rows, at = [], first_id
    for s, m in enumerate(sessions):
        if isinstance(m, np.ndarray):
            flat = m.reshape(len(m), -1)
            for k, image in enumerate(flat):
                rows += [(at + k, s, int(p), float(image[p])) for p in np.flatnonzero(image)]
            at += len(m)
            continue
        part = (lambda name, m=m: np.asarray(m[name] if isinstance(m, Mapping) else getattr(m, name)))
        data, indices, indptr = part("data"), part("indices"), part("indptr")
        for k in range(len(indptr) - 1):
            rows += [(at + k, s, int(p), float(v)) for p, v in zip(indices[indptr[k] : indptr[k + 1]], data[indptr[k] : indptr[k + 1]], strict=True)]
        at += len(indptr) - 1
    return spark.createDataFrame(rows, "roi_id long, session_id int, pixel long, weight double")


def sessions(spark: SparkSession, n: int, height: int, width: int, um_per_pixel: float | Sequence[float]) -> DataFrame:
    """One row per session; a single scale holds for all, whole numbers are refused."""
    scales = [um_per_pixel] * n if isinstance(um_per_pixel, float) else list(um_per_pixel) if not isinstance(um_per_pixel, int) else []
    if len(scales) != n or not all(isinstance(x, float) for x in scales):
        raise ValueError("um_per_pixel is a float, or one float per session")
    return spark.createDataFrame([(s, height, width, u) for s, u in enumerate(scales)], "session_id int, fov_height int, fov_width int, um_per_pixel double")


def fov_images(spark: SparkSession, images: Sequence[np.ndarray]) -> DataFrame:
    if len({i.shape for i in images}) > 1:
        raise ValueError("fields of view must have one size")
    return spark.createDataFrame([(s, np.asarray(i, float).ravel().tolist()) for s, i in enumerate(images)], "session_id int, img array<double>")


def fov_from_ops(spark: SparkSession, paths: Sequence[str], kind: str = "meanImgE") -> DataFrame:
    """Mean images of NumPy ``ops`` files, one per session; an enhanced image that covers only the valid range is set into the frame.

    Files hold pickled records; read only files you trust.
    """
    images = []
    for p in paths:
        ops = np.load(p.removeprefix("file://"), allow_pickle=True).item()
        image = np.asarray(ops[kind], float)
        full = np.asarray(ops["meanImg"]).shape if "meanImg" in ops else image.shape
        if image.shape != full:
            (y0, y1), (x0, x1) = ops["yrange"], ops["xrange"]
            framed = np.zeros(full)
            framed[y0:y1, x0:x1] = image
            image = framed
        images.append(image)
    return fov_images(spark, images)


def from_extractors(spark: SparkSession, extractors: Iterable[Any]) -> DataFrame:
    """Footprints of objects that offer ``get_roi_image_masks() -> (h, w, n)``, one per session."""
    return footprints(spark, [np.moveaxis(np.asarray(e.get_roi_image_masks(), float), -1, 0) for e in extractors])


def from_dict(spark: SparkSession, tables: Mapping[str, Sequence[Mapping[str, Any]]], schemas: Mapping[str, str]) -> dict[str, DataFrame]:
    """Tables given as lists of records; unknown names are an error."""
    unknown = set(tables) - set(schemas)
    if unknown:
        raise KeyError(f"unknown tables: {', '.join(sorted(unknown))}")
    return {name: spark.createDataFrame([tuple(r.get(c.strip().split()[0]) for c in schemas[name].split(",")) for r in rows], schemas[name]) for name, rows in tables.items()}


def save_json(value: Any, path: str) -> None:
    Path(path).write_text(json.dumps(value, sort_keys=True, indent=1))


def load_json(path: str) -> Any:
    return json.loads(Path(path).read_text())


def save_yaml(value: Any, path: str) -> None:
    """Needs PyYAML, which is not required otherwise."""
    import yaml

    Path(path).write_text(yaml.safe_dump(value, sort_keys=True))


def load_yaml(path: str) -> Any:
    import yaml

    return yaml.safe_load(Path(path).read_text())
