"""Image registration: phase correlation, frequency filters, rigid fits, alignment scores.

Images are few (one per session); each pair is one row of work for an Arrow-batched NumPy
function, and the sessions' graph of pairwise scores is solved on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.graph import shortest_paths


def butterworth(height: int, width: int, low: float, high: float, order: int = 3) -> np.ndarray:
    """Analytic band-pass gain on the FFT grid; frequencies in cycles per pixel, 0 leaves a side open."""
    fy, fx = np.fft.fftfreq(height)[:, None], np.fft.fftfreq(width)[None, :]
    r = np.sqrt(fy**2 + fx**2)
    gain = np.ones_like(r)
    if high:
        gain = gain / np.sqrt(1 + (r / high) ** (2 * order))
    if low:
        gain = gain / np.sqrt(1 + (low / np.maximum(r, 1e-12)) ** (2 * order))
    return gain


def phase_correlation(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Correlation surface of the two images' phases, zero shift in the middle."""
    f = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
    f = f / np.maximum(np.abs(f), 1e-12)
    return np.fft.fftshift(np.real(np.fft.ifft2(f if mask is None else f * mask)))


def translation(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None) -> tuple[int, int, float]:
    """``(dy, dx, peak)``: moving ``b`` by it lays it over ``a``."""
    surface = phase_correlation(a, b, mask)
    y, x = np.unravel_index(int(surface.argmax()), surface.shape)
    return int(y) - surface.shape[0] // 2, int(x) - surface.shape[1] // 2, float(surface.max())


def shift_score(surface: np.ndarray, radius: int) -> dict[str, float]:
    """Middle against surround of a correlation surface: mean and deviation, 95th percentile, maximum, ``z_in``, ``r_in``."""
    h, w = surface.shape
    y, x = np.mgrid[:h, :w]
    inside = (y - h // 2) ** 2 + (x - w // 2) ** 2 <= radius**2
    mid, out = surface[inside], surface[~inside]
    return {
        "mean_in": float(mid.mean()), "mean_out": float(out.mean()), "std_out": float(out.std()), "p95_out": float(np.percentile(out, 95)), "max_in": float(mid.max()),
        "z_in": float((mid.max() - out.mean()) / max(out.std(), 1e-12)), "r_in": float(mid.max() / max(np.percentile(out, 95), 1e-12)),
    }


def register_pairs(fov: DataFrame, pairs: DataFrame, height: int, width: int, radius: int = 4, low: float = 0.0, high: float = 0.0) -> DataFrame:
    """``a, b, dy, dx, peak, z_in, r_in`` for each pair of sessions; ``fov(session_id, img)``."""
    left = pairs.join(fov.select(F.col("session_id").alias("a"), F.col("img").alias("ia")), "a")
    both = left.join(fov.select(F.col("session_id").alias("b"), F.col("img").alias("ib")), "b").select("a", "b", "ia", "ib")
    mask = butterworth(height, width, low, high) if low or high else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                x, y = (np.array(i, float).reshape(height, width) for i in (r.ia, r.ib))
                dy, dx, peak = translation(x, y, mask)
                score = shift_score(phase_correlation(x, np.roll(y, (dy, dx), (0, 1)), mask), radius)
                rows.append((r.a, r.b, dy, dx, peak, score["z_in"], score["r_in"]))
            yield pd.DataFrame(rows, columns=["a", "b", "dy", "dx", "peak", "z_in", "r_in"])

    return both.mapInPandas(run, "a int, b int, dy int, dx int, peak double, z_in double, r_in double")


def to_template(scores: DataFrame, template: int, z_threshold: float = 4.0) -> DataFrame:
    """``session_id, dy, dx, aligned``: shifts to the template along the path of best scores.

    The scores' table has a row per pair of sessions. A pair passes if its ``z_in`` reaches the
    threshold; its cost is ``1 / z_in``. Sessions without a path are not aligned.
    """
    rows = scores.select("a", "b", "dy", "dx", "z_in").collect()
    ids = sorted({r["a"] for r in rows} | {r["b"] for r in rows} | {template})
    at = {s: k for k, s in enumerate(ids)}
    edges, shift = [], {}
    for r in rows:
        if r["z_in"] >= z_threshold and r["a"] != r["b"]:
            a, b = at[r["a"]], at[r["b"]]
            edges += [(a, b, 1 / r["z_in"]), (b, a, 1 / r["z_in"])]
            shift[a, b], shift[b, a] = (r["dy"], r["dx"]), (-r["dy"], -r["dx"])
    paths = shortest_paths(len(ids), edges, at[template])
    out = []
    for s in ids:
        path = paths.get(at[s], (None, None))[1]
        steps = [shift[p, q] for p, q in zip(path, path[1:])] if path else []  # noqa: B905
        out.append((s, sum(d[0] for d in steps), sum(d[1] for d in steps), path is not None))
    return scores.sparkSession.createDataFrame(out, "session_id int, dy int, dx int, aligned boolean")


def chain(shifts: DataFrame) -> DataFrame:
    """Shifts of each session against the one before, added up: ``session_id, dy, dx`` against the first (one row a session)."""
    w = Window.orderBy("session_id").rowsBetween(Window.unboundedPreceding, 0)
    return shifts.select("session_id", F.sum("dy").over(w).alias("dy"), F.sum("dx").over(w).alias("dx"))


def procrustes(moving: np.ndarray, fixed: np.ndarray, scale: bool = False) -> np.ndarray:
    """3x3 matrix of the rotation, shift (and scale) that takes ``moving`` (n x 2, x then y) closest to ``fixed``; identity below 3 points."""
    if len(moving) < 3:
        return np.eye(3)
    cm, cf = moving.mean(0), fixed.mean(0)
    u, s, vt = np.linalg.svd((moving - cm).T @ (fixed - cf))
    flip = np.diag([1.0, np.sign(np.linalg.det(vt.T @ u.T))])
    r = vt.T @ flip @ u.T
    k = float((s * np.diag(flip)).sum() / max(((moving - cm) ** 2).sum(), 1e-12)) if scale else 1.0
    out = np.eye(3)
    out[:2, :2], out[:2, 2] = k * r, cf - k * r @ cm
    return out


def fit_linear(moving: np.ndarray, fixed: np.ndarray, kind: str) -> np.ndarray:
    """Least-squares matrix of a kind: euclidean, similarity, affine or homography."""
    if kind in ("euclidean", "similarity"):
        return procrustes(moving, fixed, kind == "similarity")
    n = len(moving)
    if n < (3 if kind == "affine" else 4):
        return np.eye(3)
    x, y = moving.T
    if kind == "affine":
        solved, *_ = np.linalg.lstsq(np.stack([x, y, np.ones(n)], 1), fixed, rcond=None)
        out = np.eye(3)
        out[:2] = solved.T
        return out
    u, v = fixed.T
    zero, one = np.zeros(n), np.ones(n)
    rows = np.concatenate([np.stack([-x, -y, -one, zero, zero, zero, u * x, u * y, u], 1), np.stack([zero, zero, zero, -x, -y, -one, v * x, v * y, v], 1)])
    h = np.linalg.svd(rows)[2][-1].reshape(3, 3)
    return h / h[2, 2]


def ransac(moving: np.ndarray, fixed: np.ndarray, kind: str = "euclidean", threshold: float = 2.0, trials: int = 200, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``(matrix, inlier mask)``: the fit most points agree with, refitted on them; seeded."""
    rng = np.random.default_rng(seed)
    need = {"euclidean": 3, "similarity": 3, "affine": 3, "homography": 4}[kind]
    best = np.zeros(len(moving), bool)
    if len(moving) < need:
        return np.eye(3), best
    for _ in range(trials):
        some = rng.choice(len(moving), need, replace=False)
        moved = np.c_[moving, np.ones(len(moving))] @ fit_linear(moving[some], fixed[some], kind).T
        with np.errstate(all="ignore"):
            off = np.linalg.norm(moved[:, :2] / moved[:, 2:] - fixed, axis=1)
        inside = off <= threshold
        if inside.sum() > best.sum():
            best = inside
    return (fit_linear(moving[best], fixed[best], kind) if best.sum() >= need else np.eye(3)), best
