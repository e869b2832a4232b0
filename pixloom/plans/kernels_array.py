"""Resampling of one raster with arrays: the same weights as the DataFrame form."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def _windowed(limit: float, f: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    return lambda d: np.where(d < limit, f(d), 0.0)


def _bicubic(d: np.ndarray) -> np.ndarray:
    far = np.where(d <= 2.0, 4.0 + d * (d * (5.0 - d) - 8.0), 0.0)
    return np.where(d <= 1.0, (d - 2.0) * d * d + 1.0, far)


KERNELS: dict[str, tuple[Callable[[np.ndarray], np.ndarray], float]] = {
    "bilinear": (_windowed(1.0, lambda d: 1.0 - d), 1.0),
    "welsh": (_windowed(1.0, lambda d: 1.0 - d * d), 1.0),
    "bicubic": (_bicubic, 2.0),
    "gaussian": (lambda d: np.exp(d * d * -2.0) * math.sqrt(2.0 / math.pi), 1.0),
    "hanning": (lambda d: np.cos(d * math.pi) * 0.5 + 0.5, 1.0),
    "hamming": (lambda d: np.cos(d * math.pi) * 0.46 + 0.54, 1.0),
} | {f"lanczos{n}": (_windowed(float(n), lambda d, n=n: np.sinc(d) * np.sinc(d / n)), float(max(3, n))) for n in (2, 3, 4)}


def axis_matrix(size: int, to: int, kernel: str) -> np.ndarray:
    """Weights, target x source."""
    weigh, support = KERNELS[kernel]
    t, s = np.arange(to)[:, None], np.arange(size)[None, :]
    if to >= size:
        center = (t + 0.5) * size / to
        first, last = np.trunc(np.maximum(center - support, 0)), np.trunc(np.minimum(center + support, size - 1))
        distance = np.abs(s + 0.5 - center)
    else:
        center = t + 0.5
        first, last = np.maximum(np.floor((center - support) * size / to), 0), np.minimum(np.floor((center + support) * size / to), size - 1)
        distance = np.abs((s + 0.5) * to / size - center)
    return np.where((s >= first) & (s <= last), weigh(distance), 0.0)


def resize_array(raster: np.ndarray, width: int, height: int, kernel: str = "bilinear") -> np.ndarray:
    """rows x columns x 3 to height x width x 3; pixels without weight stay black."""
    h, w, _ = raster.shape
    if (w, h) == (width, height):
        return raster
    if kernel == "nearest":
        return raster[(np.arange(height) * h // height)[:, None], np.arange(width) * w // width]
    down, across = axis_matrix(h, height, kernel), axis_matrix(w, width, kernel)
    sums = np.einsum("ty,yxc,ux->tuc", down, raster.astype(np.float64), across, optimize=True)
    total = down.sum(axis=1)[:, None, None] * across.sum(axis=1)[None, :, None]
    out = np.floor(np.round(sums / np.where(total > 0, total, 1.0), 9))
    return np.where(total > 0, np.clip(out, 0, 255), 0).astype(np.uint8)
