"""A classifier in one file: how images are prepared, embedded and classified, and under which names.

The file is a zip whose bytes depend on its content alone. ``predict`` replays the recorded
preparation, so inference cannot differ from training; only the data's own resolution is given.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import zipfile
from pathlib import Path

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import images as I
from tessera.operators.classify import SCHEMA_VERSION, IntegrityError, predict_saved

SUFFIX = ".tessera_classifier"
MEMBERS = ("classifier.json", "embedding.json", "preprocessing.json")
EPOCH = (1980, 1, 1, 0, 0, 0)


def build(model: LogisticRegressionModel, classes: list, names: list[str], height: int, width: int, scales: int = 2, angles: int = 12, scale_images: bool = True) -> dict:
    """A package from a model fitted on ``embed``'s vectors; ``names`` are those of the ascending ``classes``."""
    return checked({
        "classifier": {"classes": list(classes), "names": list(names), "coefficients": model.coefficientMatrix.toArray().tolist(), "intercepts": model.interceptVector.toArray().tolist()},
        "embedding": {"kind": "scattering", "scales": scales, "angles": angles},
        "preprocessing": {"height": height, "width": width, "scale_images": scale_images},
    })


def latent_width(package: dict) -> int:
    """Values of one embedded image."""
    scales, angles = package["embedding"]["scales"], package["embedding"]["angles"]
    side = -(-package["preprocessing"]["height"] // 2**scales) * -(-package["preprocessing"]["width"] // 2**scales)
    return side * (1 + scales * angles + angles**2 * scales * (scales - 1) // 2)


def checked(package: dict) -> dict:
    """The package, or an ``IntegrityError`` naming what does not fit together."""
    c = package["classifier"]
    if not c["classes"] or sorted(set(c["classes"])) != c["classes"]:
        raise IntegrityError("classes must be distinct and ascending")
    if len(c["names"]) != len(c["classes"]) or len(set(c["names"])) != len(c["names"]):
        raise IntegrityError("there must be one distinct name for each class")
    if package["embedding"].get("kind") != "scattering":
        raise IntegrityError("unknown kind of embedding")
    rows = len(c["coefficients"])
    if rows != len(c["intercepts"]) or rows not in ({1, 2} if len(c["classes"]) == 2 else {len(c["classes"])}):
        raise IntegrityError("the weights do not fit the classes")
    if any(len(w) != latent_width(package) for w in c["coefficients"]):
        raise IntegrityError("the weights do not fit the embedding")
    return package


def _member(name: str, content: bytes, into: zipfile.ZipFile) -> None:
    info = zipfile.ZipInfo(name, EPOCH)
    info.external_attr, info.compress_type = 0o644 << 16, zipfile.ZIP_DEFLATED
    into.writestr(info, content, compresslevel=6)


def to_bytes(package: dict) -> bytes:
    """The zip file's bytes: members in a fixed order, no times, a SHA-256 of each in ``metadata.json``."""
    data = {m: json.dumps(package[m.removesuffix(".json")], sort_keys=True, indent=1).encode() for m in MEMBERS}
    meta = {"schema_version": SCHEMA_VERSION, "sha256": {m: hashlib.sha256(d).hexdigest() for m, d in data.items()}}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        _member("metadata.json", json.dumps(meta, sort_keys=True, indent=1).encode(), z)
        for name in MEMBERS:
            _member(name, data[name], z)
    return out.getvalue()


def save(package: dict, path: str, overwrite: bool = False) -> str:
    """Write the file, whole or not at all; returns its path, with the suffix added where it is missing."""
    at = Path(path if path.endswith(SUFFIX) else path + SUFFIX)
    if at.exists() and not overwrite:
        raise FileExistsError(str(at))
    at.parent.mkdir(parents=True, exist_ok=True)
    half = at.with_name(at.name + ".part")
    half.write_bytes(to_bytes(checked(package)))
    os.replace(half, at)
    return str(at)


def load(path: str) -> dict:
    """The package, after all checks: version, members, hashes, classes, widths."""
    try:
        with zipfile.ZipFile(path) as z:
            found = {n: z.read(n) for n in z.namelist()}
    except zipfile.BadZipFile as bad:
        raise IntegrityError("not a package file") from bad
    if "metadata.json" not in found:
        raise IntegrityError("metadata.json is missing")
    meta = json.loads(found["metadata.json"])
    if meta.get("schema_version") != SCHEMA_VERSION:
        raise IntegrityError("unknown schema version")
    for name in MEMBERS:
        if name not in found or name not in meta["sha256"]:
            raise IntegrityError(f"{name} is missing")
        if hashlib.sha256(found[name]).hexdigest() != meta["sha256"][name]:
            raise IntegrityError(f"{name} has been changed")
    return checked({n.removesuffix(".json"): json.loads(found[n]) for n in MEMBERS})


def embed(images: DataFrame, um_per_pixel: float, height: int, width: int, scales: int = 2, angles: int = 12, scale_images: bool = True) -> DataFrame:
    """``roi_id, vec`` of raw ``images(roi_id, img)``; every image stands for itself, so batches do not matter."""
    one = F.when(F.size("img") == height * width, F.col("img")).otherwise(F.raise_error(F.lit(f"images must be {height} x {width}")).cast("array<double>"))
    raw = images.select("roi_id", one.alias("img"))
    return I.scattering_latents(I.normalise_scale(raw, um_per_pixel, height, width) if scale_images else raw, height, width, scales, angles)


def predict(package: dict, images: DataFrame, um_per_pixel: float) -> DataFrame:
    """``roi_id, label_id, name, proba`` of raw images; ``label_id`` is the place of the class, no image gives no row."""
    p, e, c = package["preprocessing"], package["embedding"], package["classifier"]
    vectors = embed(images, um_per_pixel, p["height"], p["width"], e["scales"], e["angles"], p["scale_images"])
    places = {"classes": list(range(len(c["classes"]))), "coefficients": c["coefficients"], "intercepts": c["intercepts"]}
    found = predict_saved(places, vectors)
    names = F.array(*(F.lit(n) for n in c["names"]))
    return found.select("roi_id", F.col("predicted").alias("label_id"), F.element_at(names, F.col("predicted") + 1).alias("name"), "proba")
