"""Resampling kernels: a distance column to a weight column, each with its support."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _inside(d: Column, limit: float, value: Column) -> Column:
    return F.when(d < limit, value).otherwise(F.lit(0.0))


def _sinc(x: Column) -> Column:
    return F.sin(x * math.pi) / (x * math.pi)


def _lanczos(n: int) -> Callable[[Column], Column]:
    return lambda d: F.when(d == 0.0, F.lit(1.0)).otherwise(_inside(d, float(n), _sinc(d) * _sinc(d / float(n))))


def _bicubic(d: Column) -> Column:
    near = (d - 2.0) * d * d + 1.0
    far = F.lit(4.0) + d * (d * (F.lit(5.0) - d) - 8.0)
    return F.when(d <= 1.0, near).when(d <= 2.0, far).otherwise(F.lit(0.0))


#: Name to (weight of a distance, pixels of support on each side).
KERNELS: dict[str, tuple[Callable[[Column], Column], float]] = {
    "bilinear": (lambda d: _inside(d, 1.0, F.lit(1.0) - d), 1.0),
    "welsh": (lambda d: _inside(d, 1.0, F.lit(1.0) - d * d), 1.0),
    "bicubic": (_bicubic, 2.0),
    "lanczos2": (_lanczos(2), 3.0),
    "lanczos3": (_lanczos(3), 3.0),
    "lanczos4": (_lanczos(4), 4.0),
    "gaussian": (lambda d: F.exp(d * d * -2.0) * math.sqrt(2.0 / math.pi), 1.0),
    "hanning": (lambda d: F.cos(d * math.pi) * 0.5 + 0.5, 1.0),
    "hamming": (lambda d: F.cos(d * math.pi) * 0.46 + 0.54, 1.0),
}
