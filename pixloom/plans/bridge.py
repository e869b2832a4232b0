"""Synthetic rasters made from the driver's tables; the tables hold no images.

An embedding of 64 numbers becomes an 8 x 8 picture: element p is the pixel at
row p div 8 and column p mod 8, its red sample is the number scaled from -1..1,
green and blue are multiples of it modulo 256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixloom.functions.color import clamp

SIDE = 8


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x, r, g, b (all long)."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("pos", "v")
    )
    red = clamp(F.floor((F.col("v").cast("double") + 1.0) * 127.5).cast("long"))
    return rows.select(
        "image_id", F.expr("CAST(pos DIV 8 AS BIGINT)").alias("y"), F.expr("CAST(pos % 8 AS BIGINT)").alias("x"), red.alias("r")
    ).withColumns({"g": F.col("r") * 7 % 256, "b": F.col("r") * 13 % 256})


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, width, height, pixels (packed RGB888): the same pictures as one row each; native."""
    red = lambda v: clamp(F.floor((v.cast("double") + 1.0) * 127.5).cast("long"))
    byte = lambda c: F.lpad(F.hex(c), 2, "0")
    packed = F.unhex(F.array_join(F.transform("embedding", lambda v: F.concat(byte(red(v)), byte(red(v) * 7 % 256), byte(red(v) * 13 % 256))), ""))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("image_id"), F.lit(SIDE).alias("width"), (F.size("embedding") / SIDE).cast("int").alias("height"), packed.alias("pixels")
    )


#: The same pictures for DuckDB; queries put it first in their WITH clause.
PIX_SQL = """pix AS (
  SELECT image_id, pos // 8 AS y, pos % 8 AS x, r, r * 7 % 256 AS g, r * 13 % 256 AS b FROM (
    SELECT image_id, pos, CAST(greatest(0, least(255, floor((CAST(v AS DOUBLE) + 1) * 127.5))) AS BIGINT) AS r FROM (
      SELECT vec_id AS image_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings)))"""
