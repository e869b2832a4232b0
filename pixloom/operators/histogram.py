"""Colour statistics: histogram, distinct colours, box boundaries and representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixloom.functions.color import RGB, bucket15, bucket_rgb, div

#: Most pixels looked at by quality.
SAMPLE_CAPS = {"low": 18383, "high": 1118383, "full": 4003079}
COUNT_CAP = 65535


def sampled(pixels: DataFrame, width: int, height: int, quality: str = "low") -> DataFrame:
    """Every stride-th pixel in raster order; adds ``pos``."""
    stride = max(1, width * height // SAMPLE_CAPS[quality])
    placed = pixels.withColumn("pos", F.col("y") * width + F.col("x"))
    return placed if stride == 1 else placed.where(F.col("pos") % stride == 0)


def histogram(pixels: DataFrame) -> DataFrame:
    """image_id, bucket, n (capped counter) and first_pos of each 15-bit colour; needs ``pos``."""
    bucket = bucket15(*[F.col(c) for c in RGB])
    return pixels.groupBy("image_id", bucket.alias("bucket")).agg(
        F.least(F.count("*"), F.lit(COUNT_CAP).cast("long")).alias("n"), F.min("pos").alias("first_pos")
    )


def with_colour(hist: DataFrame) -> DataFrame:
    return hist.withColumns(dict(zip(RGB, bucket_rgb(F.col("bucket")))))


def dominant(hist: DataFrame, k: int) -> DataFrame:
    """The k most frequent colours of each picture, ties by bucket."""
    order = Window.partitionBy("image_id").orderBy(F.col("n").desc(), "bucket")
    return hist.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def box_stats(hist: DataFrame) -> DataFrame:
    """Of all colours of a picture as one box: bounds, the three representatives, both largest dimensions."""
    aggs = [F.count("*").alias("colours"), F.sum("n").alias("n")]
    for c in RGB:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.sum(c).alias(f"{c}_sum"), F.sum(F.col(c) * F.col("n")).alias(f"{c}_weighted")]
    box = with_colour(hist).groupBy("image_id").agg(*aggs)
    spread = {c: F.col(f"{c}_max") - F.col(f"{c}_min") for c in RGB}
    top = F.greatest(*spread.values())
    #: Luminosity weights of the planes.
    lum = {c: spread[c] * w for c, w in zip(RGB, (0.2989, 0.5866, 0.1145))}
    lum_top = F.greatest(*lum.values())

    def first(values, best):
        return F.when(values["r"] == best, 0).when(values["g"] == best, 1).otherwise(2).cast("long")

    out = {"by_norm": first(spread, top), "by_luminosity": first(lum, lum_top)}
    for c in RGB:
        out[f"{c}_center"] = div(F.col(f"{c}_min") + F.col(f"{c}_max"), 2)
        out[f"{c}_mean"] = div(F.col(f"{c}_sum"), F.col("colours"))
        out[f"{c}_pixel_mean"] = div(F.col(f"{c}_weighted"), F.col("n"))
    return box.select("image_id", "colours", "n", *[f"{c}_{e}" for c in RGB for e in ("min", "max")], *[v.alias(k) for k, v in out.items()])


def median_split(hist: DataFrame, plane: str) -> DataFrame:
    """Which side each colour falls on when a picture's box is cut at the pixel median of a plane (ties by bucket)."""
    whole = Window.partitionBy("image_id")
    order = whole.orderBy(plane, "bucket")
    ranked = with_colour(hist).withColumns({
        "i": F.row_number().over(order).cast("long"), "size": F.count("*").over(whole), "total": F.sum("n").over(whole),
        "before": F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    # The lower side grows while it holds less than half of the pixels, but leaves one colour above.
    lower = (F.col("i") == 1) | ((F.col("before") < div(F.col("total"), 2)) & (F.col("i") < F.col("size")))
    return ranked.withColumn("lower", lower).select("image_id", "bucket", "n", "lower")
