"""Small per-object images: resizing, contrast, wavelet features, embedding interface. Arrow batches of NumPy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def clahe(image: np.ndarray, grid: tuple[int, int] = (8, 8), clip: float = 2.0, bins: int = 256) -> np.ndarray:
    """Local histogram equalisation with clipped histograms, bilinear between tiles; result in 0..1."""
    span = image.max() - image.min()
    x = (image - image.min()) / span if span > 0 else np.zeros_like(image, dtype=float)
    level = np.minimum((x * bins).astype(int), bins - 1)
    h, w = image.shape
    gy, gx = grid
    ys, xs = np.linspace(0, h, gy + 1).astype(int), np.linspace(0, w, gx + 1).astype(int)
    maps = np.empty((gy, gx, bins))
    for a in range(gy):
        for b in range(gx):
            tile = level[ys[a] : max(ys[a + 1], ys[a] + 1), xs[b] : max(xs[b + 1], xs[b] + 1)]
            count = np.bincount(tile.ravel(), minlength=bins).astype(float)
            most = max(clip * tile.size / bins, 1.0)
            over = np.maximum(count - most, 0).sum()
            maps[a, b] = np.cumsum(np.minimum(count, most) + over / bins) / tile.size
    cy = np.clip((np.arange(h) + 0.5) / h * gy - 0.5, 0, gy - 1)
    cx = np.clip((np.arange(w) + 0.5) / w * gx - 0.5, 0, gx - 1)
    y0, x0 = np.floor(cy).astype(int), np.floor(cx).astype(int)
    y1, x1 = np.minimum(y0 + 1, gy - 1), np.minimum(x0 + 1, gx - 1)
    fy, fx = (cy - y0)[:, None], (cx - x0)[None, :]
    at = lambda y, x: maps[y[:, None], x[None, :], level]
    return (1 - fy) * ((1 - fx) * at(y0, x0) + fx * at(y0, x1)) + fy * ((1 - fx) * at(y1, x0) + fx * at(y1, x1))


def _cubic(t: np.ndarray, a: float = -0.75) -> np.ndarray:
    t = np.abs(t)
    return np.where(t <= 1, ((a + 2) * t - (a + 3)) * t * t + 1, np.where(t < 2, ((a * t - 5 * a) * t + 8 * a) * t - 4 * a, 0.0))


def resample(image: np.ndarray, sy: np.ndarray, sx: np.ndarray, method: str = "bilinear", fill: float = 0.0) -> np.ndarray:
    """Image values at source coordinates: nearest, bilinear or bicubic; ``fill`` outside."""
    h, w = image.shape
    reach = {"nearest": [0], "bilinear": [0, 1], "bicubic": [-1, 0, 1, 2]}[method]
    y0, x0 = (np.floor(sy + 0.5), np.floor(sx + 0.5)) if method == "nearest" else (np.floor(sy), np.floor(sx))
    weight = {"nearest": lambda t: np.ones_like(t), "bilinear": lambda t: 1 - np.abs(t), "bicubic": _cubic}[method]
    out = np.zeros(np.broadcast(sy, sx).shape)
    for a in reach:
        for b in reach:
            y, x = (y0 + a).astype(int), (x0 + b).astype(int)
            ok = (y >= 0) & (y < h) & (x >= 0) & (x < w)
            out += weight(sy - y) * weight(sx - x) * np.where(ok, image[np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)], fill)
    return out


def scale_about_centre(image: np.ndarray, factor: float, method: str = "bicubic") -> np.ndarray:
    """Enlarged by ``factor`` about the middle, same size, clipped to the input's range."""
    h, w = image.shape
    y, x = np.mgrid[:h, :w].astype(float)
    out = resample(image, (y - (h - 1) / 2) / factor + (h - 1) / 2, (x - (w - 1) / 2) / factor + (w - 1) / 2, method)
    return np.clip(out, image.min(), image.max())


def scattering_filters(size: int, scales: int = 2, angles: int = 12) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """Fourier-domain oriented band-pass filters per scale, and the low-pass."""
    fy, fx = np.fft.fftfreq(size)[:, None] * 2 * np.pi, np.fft.fftfreq(size)[None, :] * 2 * np.pi
    bands = []
    for j in range(scales):
        sigma, centre = 0.8 * 2**j, 3 * np.pi / 4 / 2**j
        for k in range(angles):
            t = np.pi * k / angles
            u, v = fx * np.cos(t) + fy * np.sin(t), -fx * np.sin(t) + fy * np.cos(t)
            g = lambda u, v=v, s=sigma: np.exp(-(s**2) * (u**2 + (v * 2) ** 2) / 2)
            bands.append((j, g(u - centre) - g(u) * (g(-centre, 0.0) / g(0.0, 0.0))))
    return bands, np.exp(-((0.8 * 2**scales) ** 2) * (fx**2 + fy**2) / 2)


def scattering(images: np.ndarray, scales: int = 2, angles: int = 12) -> np.ndarray:
    """First and second order scattering features of square images, pooled on the coarse grid."""
    bands, low = scattering_filters(images.shape[1], scales, angles)
    step = 2**scales
    pool = lambda x: np.real(np.fft.ifft2(np.fft.fft2(x) * low))[:, ::step, ::step].reshape(len(x), -1)
    out = [pool(images)]
    spectrum = np.fft.fft2(images)
    for j, band in bands:
        first = np.abs(np.fft.ifft2(spectrum * band))
        out.append(pool(first))
        second = np.fft.fft2(first)
        out += [pool(np.abs(np.fft.ifft2(second * other))) for i, other in bands if i > j]
    return np.concatenate(out, 1)


def map_images(images: DataFrame, fn: Callable[[np.ndarray], np.ndarray], height: int, width: int, out: str = "vec", batch: int = 256) -> DataFrame:
    """``roi_id, <out>``: any function of a stack of images (n, h, w) to vectors (n, d), in batches.

    This is the interface for image embeddings: pass a network's forward function; the network
    itself, and its weights, are not part of this library.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                stack = np.stack(part.column(1).to_numpy(zero_copy_only=False)).astype(float).reshape(-1, height, width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(np.asarray(fn(stack), float)), pa.list_(pa.float64()))], ["roi_id", out])

    return images.select("roi_id", "img").mapInArrow(run, f"roi_id long, {out} array<double>")


def normalise_scale(images: DataFrame, um_per_pixel: float, height: int, width: int) -> DataFrame:
    """``roi_id, img`` of objects brought to one physical scale."""
    factor = um_per_pixel * 1.2 * height / 36
    return map_images(images, lambda x: np.stack([scale_about_centre(i, factor) for i in x]).reshape(len(x), -1), height, width, "img")


def scattering_latents(images: DataFrame, height: int, width: int, scales: int = 2, angles: int = 12) -> DataFrame:
    return map_images(images, lambda x: scattering(x, scales, angles), height, width)
