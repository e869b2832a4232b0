"""Crop and resampling of pixel tables.

Resampling never compares every source pixel with every target pixel: a target
axis is expanded into the source positions inside the kernel's support, so both
steps are equi-joins on (image_id, position), first along x, then along y.  The
kernels are separable, which makes the two passes equal to the product form.
"""

from __future__ import annotations

import re

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixloom.functions.color import RGB, clamp, div
from pixloom.functions.kernels import KERNELS

LIMIT = 1_000_000  # pixels of a side


@dataclass(frozen=True)
class Crop:
    width: int
    height: int
    x: int = 0
    y: int = 0


def crop(pixels: DataFrame, box: Crop, width: int, height: int) -> DataFrame:
    """The part of a picture inside the box, moved to 0, 0; a box quite outside changes nothing."""
    if box.x >= width or box.y >= height or box.width <= 0 or box.height <= 0:
        return pixels
    inside = (F.col("x") >= box.x) & (F.col("x") < box.x + box.width) & (F.col("y") >= box.y) & (F.col("y") < box.y + box.height)
    return pixels.where(inside).withColumns({"x": F.col("x") - box.x, "y": F.col("y") - box.y})


def target_size(width: int, height: int, to_width: int | str | None = None, to_height: int | str | None = None) -> tuple[int, int]:
    """Pixels, ``"150%"`` or None; a missing side keeps the aspect ratio, rounded up."""

    def asked(value: int | str | None, source: int) -> int | None:
        if value in (None, "auto"):
            return None
        m = re.fullmatch(r"([0-9]+)(%|px|)", str(value))
        if not m:
            raise ValueError(f"{value!r} is no size")
        return min(LIMIT, max(1, source * int(m[1]) // 100 if m[2] == "%" else int(m[1])))

    w, h = asked(to_width, width), asked(to_height, height)
    if w and not h:
        h = min(LIMIT, max(1, -(-height * w // width)))
    if h and not w:
        w = min(LIMIT, max(1, -(-width * h // height)))
    return w or width, h or height


def resize_nearest(pixels: DataFrame, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """Each source pixel yields the target pixels that read it: no join at all."""

    def readers(pos: Column, size: int, to: int) -> Column:
        # w * size div to = pos  <=>  ceil(pos * to / size) <= w < ceil((pos + 1) * to / size)
        first, after = div(pos * to + (size - 1), size), div((pos + 1) * to + (size - 1), size)
        return F.when(after > first, F.sequence(first, after - 1)).otherwise(F.array().cast("array<bigint>"))

    return (
        pixels.withColumn("__x", F.explode(readers(F.col("x"), width, to_width)))
        .withColumn("__y", F.explode(readers(F.col("y"), height, to_height)))
        .select("image_id", F.col("__y").alias("y"), F.col("__x").alias("x"), *RGB)
    )


def axis_weights(spark, size: int, to: int, kernel: str) -> DataFrame:
    """(target, source, weight) along one axis.

    Enlarging measures distances in source pixels, reducing in target pixels.
    """
    weigh, support = KERNELS[kernel]
    w = F.col("target")
    if to >= size:
        center = (w + 0.5) * size / to
        first, last = F.greatest(center - support, F.lit(0.0)), F.least(center + support, F.lit(size - 1.0))
        offset = (F.col("source") + 0.5) - center
    else:
        center = w + 0.5
        first = F.greatest(F.floor((center - support) * size / to).cast("double"), F.lit(0.0))
        last = F.least(F.floor((center + support) * size / to).cast("double"), F.lit(size - 1.0))
        offset = (F.col("source") + 0.5) * to / size - center
    return (
        spark.range(to).select(F.col("id").alias("target"))
        .withColumn("source", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
        .withColumn("weight", weigh(F.abs(offset)))
    )


def _along(rows: DataFrame, axis: str, size: int, to: int, kernel: str) -> DataFrame:
    """Weighted sums of r, g, b and total along one axis; one aggregation, keyed by picture, line and target."""
    weights = axis_weights(rows.sparkSession, size, to, kernel)
    if max(size, to) * 9 <= BROADCAST_ROWS:
        weights = F.broadcast(weights)
    line = "y" if axis == "x" else "x"
    return (
        rows.join(weights.withColumnRenamed("source", axis), axis).groupBy("image_id", line, "target")
        .agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in ("total", *RGB)]).withColumnRenamed("target", axis)
    )


def resize(pixels: DataFrame, width: int, height: int, to_width: int, to_height: int, kernel: str = "bilinear") -> DataFrame:
    """Weighted mean of the source pixels in reach, cut down and clamped; pixels of no weight are left out.

    A weight is the product of one along each axis, so the sums are taken along
    one axis, then along the other: a pixel meets the targets of a line twice
    instead of those of an area once.  The axis that shrinks more comes first.
    The weight tables have (target pixels x support) rows for the whole table of
    pictures, at most LIMIT x 9, and are broadcast below ``BROADCAST_ROWS``.
    """
    if (width, height) == (to_width, to_height):
        return pixels
    if kernel == "nearest":
        return resize_nearest(pixels, width, height, to_width, to_height)
    sums = pixels.select("image_id", "y", "x", *RGB, F.lit(1.0).alias("total"))
    axes = {"x": (width, to_width), "y": (height, to_height)}
    for axis in sorted(axes, key=lambda a: axes[a][1] / axes[a][0]):
        sums = _along(sums, axis, *axes[axis], kernel)
    return sums.where("total > 0").select(
        "image_id", "y", "x",
        # Rounding to nine places first makes the cut independent of the order of addition.
        *[clamp(F.floor(F.round(F.col(c) / F.col("total"), 9)).cast("long")).alias(c) for c in RGB],
    )


BROADCAST_ROWS = 200_000
