"""Search of the mixing parameters on a bounded, stratified sample of edges, on the driver.

The sample's size is a parameter (about a million rows at most); it is fetched once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from tessera.operators.filters import stratified_sample

SAMPLE_ROWS = 200_000


def differential_evolution(loss: Callable[[np.ndarray], float], bounds: list[tuple[float, float]], population: int = 16, generations: int = 40, weight: float = 0.7, cross: float = 0.9, seed: int = 0, patience: int = 12) -> tuple[np.ndarray, float, list[float]]:
    """``(best, its loss, best loss per generation)``; seeded, stops when ``patience`` generations bring nothing."""
    rng = np.random.default_rng(seed)
    low, high = np.array(bounds, float).T
    x = low + rng.random((population, len(bounds))) * (high - low)
    f = np.array([loss(v) for v in x])
    log = [float(f.min())]
    for _ in range(generations):
        for k in range(population):
            a, b, c = x[rng.choice([i for i in range(population) if i != k], 3, replace=False)]
            trial = np.where(rng.random(len(bounds)) < cross, np.clip(a + weight * (b - c), low, high), x[k])
            value = loss(trial)
            if value <= f[k]:
                x[k], f[k] = trial, value
        log.append(float(f.min()))
        if len(log) > patience and log[-patience - 1] - log[-1] <= 1e-12:
            break
    k = int(f.argmin())
    return x[k], float(f[k]), log


def overlap_loss(d: np.ndarray, intra: np.ndarray, n_bins: int, window: int) -> float:
    """Area shared by the estimated same and different histograms of distances; 1e6 without a crossover."""
    counts = np.histogram(d, n_bins, (0, 1))[0].astype(float)
    known = np.histogram(d[intra], n_bins, (0, 1))[0] * (len(d) / max(int(intra.sum()), 1))
    kernel = np.ones(window)
    same = np.convolve(np.maximum(counts - known, 0), kernel, "same") / np.convolve(np.ones(n_bins), kernel, "same")
    peak = int(known.argmax())
    return float((same * known).sum()) if (known[:peak] < same[:peak]).any() else 1e6


def mixing_search(edges: DataFrame, sigmoids: dict[str, tuple[float, float]], n_bins: int = 20, window: int = 3, sample: int = SAMPLE_ROWS, seed: int = 0, **options) -> dict:
    """Powers of each metric and the power mean's order of least overlap.

    ``edges(i, j, inter, <metrics>)``; ``sigmoids``: ``(mu, b)`` of each metric, held fixed.
    """
    names = list(sigmoids)
    got = stratified_sample(edges.select("i", "j", "inter", *names), "inter", sample).toPandas()
    intra = ~got["inter"].to_numpy(bool)
    active = [np.maximum(1 / (1 + np.exp(-b * (got[m].to_numpy(float) - mu))), 1e-8) for m, (mu, b) in sigmoids.items()]

    def loss(v: np.ndarray) -> float:
        p = v[-1]
        sim = np.mean([(a**w) ** p for a, w in zip(active, v[:-1], strict=True)], 0) ** (1 / p)
        return overlap_loss(1 - sim, intra, n_bins, window)

    best, value, log = differential_evolution(loss, [(0.0, 2.0)] * len(names) + [(-5.0, -0.1)], seed=seed, **options)
    return {"powers": dict(zip(names, best[:-1].tolist(), strict=True)), "p_norm": float(best[-1]), "loss": value, "log": log}
