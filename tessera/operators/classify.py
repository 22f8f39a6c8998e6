"""Classification: features, tuned logistic regression, probabilities, portable artifact."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.filters import stratified_split
from tessera.operators.ids import lookup_class
from tessera.operators.quality import log_loss, penalised_loss

SCHEMA_VERSION = 3


def _prepared(rows: DataFrame, classes: list) -> DataFrame:
    known = lookup_class(rows, classes, "label", "class_position").withColumn("features", array_to_vector(F.transform("vec", lambda x: x.cast("double"))))
    n = known.count()
    counts = known.groupBy("class_position").agg((F.lit(float(n)) / F.count("*")).alias("weight"))
    return known.join(F.broadcast(counts), "class_position")  # one row per class


def _fit(rows: DataFrame, c: float, n: int, max_iter: int) -> LogisticRegressionModel:
    return LogisticRegression(featuresCol="features", labelCol="class_position", weightCol="weight", regParam=1.0 / (c * max(n, 1)), maxIter=max_iter).fit(rows)


def _loss(model: LogisticRegressionModel, rows: DataFrame) -> float:
    scored = model.transform(rows).select("weight", F.get(vector_to_array("probability"), F.col("class_position")).alias("p"))
    return float(log_loss(scored, "p", "weight").first()[0] or 0.0)


def log_search(loss: Callable[[float], float], low: float, high: float, coarse: int = 5, most: int = 20, patience: int = 6, least_gain: float = 1e-4) -> list[tuple[float, float]]:
    """``(x, loss)`` of each trial: a coarse grid of equal ratios, then the middle of the wider gap beside the best so far.

    Ends after ``most`` trials, or ``patience`` in a row after the grid that do not lower the
    best loss by ``least_gain``.
    """
    if not 0 < low < high or coarse < 2:
        raise ValueError("bounds must be positive and ascending, with two coarse trials at least")
    step = (math.log(high) - math.log(low)) / (coarse - 1)
    found = [(x, loss(math.exp(x))) for x in (math.log(low) + k * step for k in range(coarse))][:most]
    idle = 0
    while len(found) < most and idle < patience:
        at, best = min(found, key=lambda t: t[1])
        below, above = max((x for x, _ in found if x < at), default=None), min((x for x, _ in found if x > at), default=None)
        widest = max((e for e in (below, above) if e is not None), key=lambda e: abs(e - at))
        x = (at + widest) / 2
        found.append((x, loss(math.exp(x))))
        idle = 0 if found[-1][1] < best - least_gain else idle + 1
    return [(math.exp(x), v) for x, v in found]


def autotune(rows: DataFrame, classes: list, strengths: tuple[float, ...] | None = None, test_size: float = 0.3, penalty: float = 1.0, max_iter: int = 50, key: str = "roi_id", bounds: tuple[float, float] = (1e-5, 1e3), most: int = 20, patience: int = 6) -> tuple[LogisticRegressionModel, list[dict]]:
    """``(model refitted on all rows, trials)``; ``rows`` has ``key, vec, label``.

    Classes are balanced by weight; the split is stratified and deterministic; the strength of
    least penalised test loss wins (ties: the first). Without ``strengths`` they are searched
    between ``bounds`` by ``log_search``.
    """
    split = stratified_split(_prepared(rows, classes), "class_position", key, test_size).cache()
    train, test = split.where("NOT is_test"), split.where("is_test")
    n = train.count()
    trials = []

    def trial(c: float) -> float:
        model = _fit(train, c, n, max_iter)
        a, b = _loss(model, train), _loss(model, test)
        trials.append({"C": c, "train": a, "test": b, "loss": penalised_loss(a, b, penalty)})
        return trials[-1]["loss"]

    if strengths is None:
        log_search(trial, *bounds, most=most, patience=patience)
    else:
        for c in strengths:
            trial(c)
    best = min(trials, key=lambda t: t["loss"])["C"]
    final = _fit(split.drop("is_test"), best, split.count(), max_iter)
    split.unpersist()
    return final, trials


def predict(model: LogisticRegressionModel, rows: DataFrame, classes: list) -> DataFrame:
    """``rows`` with ``predicted`` (a class value) and ``proba``; a vector of another width is an error."""
    width = model.numFeatures
    checked = F.when(F.size("vec") == width, F.col("vec")).otherwise(F.raise_error(F.lit(f"vectors must have {width} values")).cast("array<double>"))
    scored = model.transform(rows.withColumn("features", array_to_vector(F.transform(checked, lambda x: x.cast("double")))))
    names = F.array(*(F.lit(c) for c in classes))
    return scored.withColumn("proba", vector_to_array("probability")).withColumn("predicted", F.get(names, F.col("prediction").cast("int"))).drop("features", "rawPrediction", "probability", "prediction")


def save(model: LogisticRegressionModel, classes: list, path: str) -> dict:
    """A directory of members and a manifest with each one's SHA-256; bytes depend on the content alone."""
    if not classes or len(set(classes)) != len(classes) or sorted(classes) != list(classes):
        raise ValueError("classes must be distinct and ascending")
    top = Path(path)
    top.mkdir(parents=True, exist_ok=False)
    members = {
        "weights.json": {"coefficients": model.coefficientMatrix.toArray().tolist(), "intercepts": model.interceptVector.toArray().tolist()},
        "classes.json": list(classes),
    }
    manifest = {"schema_version": SCHEMA_VERSION, "width": int(model.numFeatures), "members": {}}
    for name, content in members.items():
        data = json.dumps(content, sort_keys=True).encode()
        (top / name).write_bytes(data)
        manifest["members"][name] = hashlib.sha256(data).hexdigest()
    (top / "manifest.json").write_text(json.dumps(manifest, sort_keys=True, indent=1))
    return manifest


class IntegrityError(ValueError):
    """A saved classifier's members do not match its manifest."""


def load(path: str) -> dict:
    """``classes, coefficients, intercepts``, after all checks of version, members, hashes, widths."""
    top = Path(path)
    manifest = json.loads((top / "manifest.json").read_text())
    if manifest.get("schema_version") != SCHEMA_VERSION:
        raise IntegrityError("unknown schema version")
    content = {}
    for name in ("weights.json", "classes.json"):
        if name not in manifest["members"] or not (top / name).exists():
            raise IntegrityError(f"{name} is missing")
        data = (top / name).read_bytes()
        if hashlib.sha256(data).hexdigest() != manifest["members"][name]:
            raise IntegrityError(f"{name} has been changed")
        content[name] = json.loads(data)
    classes, weights = content["classes.json"], content["weights.json"]
    if not classes or sorted(set(classes)) != classes:
        raise IntegrityError("classes must be distinct and ascending")
    if any(len(row) != manifest["width"] for row in weights["coefficients"]):
        raise IntegrityError("weights do not fit the width")
    return {"classes": classes, **weights}


def predict_saved(artifact: dict, rows: DataFrame) -> DataFrame:
    """``predicted, proba`` from a loaded artifact, in expressions only."""
    def score(weights: list[float], bias: float):
        total = F.lit(float(bias))
        parts = F.zip_with("vec", F.array(*(F.lit(float(w)) for w in weights)), lambda x, w: x.cast("double") * w)
        return total + F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)

    scores = [score(w, b) for w, b in zip(artifact["coefficients"], artifact["intercepts"], strict=True)]
    if len(scores) == 1:  # binomial models keep one row
        scores = [F.lit(0.0), scores[0]]
    top = F.greatest(*scores)
    e = [F.exp(s - top) for s in scores]
    total = sum(e[1:], e[0])
    proba = F.array(*(x / total for x in e))
    place = F.array_position(proba, F.array_max(proba)).cast("int")
    return rows.withColumn("proba", proba).withColumn("predicted", F.element_at(F.array(*(F.lit(c) for c in artifact["classes"])), place))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's sums of 1, x and x x', flattened as ``(k, v)``."""
    total = None
    for batch in batches:
        if batch.num_rows:
            x = np.stack(batch.column(0).to_numpy(zero_copy_only=False)).astype(float)
            x = np.hstack([np.ones((len(x), 1)), x])
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int64)), pa.array(total.ravel())], ["k", "v"])


def pca(vectors: DataFrame, rank: int) -> dict:
    """Components, explained variance and its share, mean: from sums that each task forms of its own rows."""
    sums = vectors.select("vec").mapInArrow(_moments, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k")["v"].to_numpy()
    size = int(round(len(sums) ** 0.5))
    total = sums.reshape(size, size)
    n, mu = total[0, 0], total[0, 1:] / total[0, 0]
    cov = (total[1:, 1:] - n * np.outer(mu, mu)) / max(n - 1, 1)
    values, basis = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:rank]
    return {"components": basis[:, order].T, "variance": values[order], "ratio": values[order] / max(values.sum(), 1e-300), "mean": mu}


def project(vectors: DataFrame, model: dict) -> DataFrame:
    """``vectors`` with ``scores`` on the components."""
    centred = F.zip_with("vec", F.array(*(F.lit(float(m)) for m in model["mean"])), lambda x, m: x.cast("double") - m)
    score = lambda c: F.aggregate(F.zip_with(centred, F.array(*(F.lit(float(v)) for v in c)), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    return vectors.withColumn("scores", F.array(*(score(c) for c in model["components"])))


def info_nce(pairs: DataFrame, temperature: float = 0.1) -> DataFrame:
    """Contrastive loss of ``pairs(i, j, s, positive)``: mean over ``i`` of -log softmax at its positives."""
    e = F.exp(F.col("s") / temperature)
    per = pairs.groupBy("i").agg(F.sum(e).alias("all"), F.sum(F.when(F.col("positive"), e)).alias("pos"))
    return per.where("pos IS NOT NULL").agg(F.avg(-F.log(F.col("pos") / F.col("all"))).alias("loss"))
