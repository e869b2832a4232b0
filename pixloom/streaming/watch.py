"""Pictures as streams: a watched folder, and an animation that never ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixloom.sources.loader import decode_files

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch_frames(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Frames of each file that arrives in a folder."""
    files = spark.readStream.format("binaryFile").schema(FILES).load(folder)
    return decode_files(files, **options)


def endless(spark: SparkSession, frames: DataFrame, per_second: int = 10) -> DataFrame:
    """An animation (frame_no from 0 without gaps) as an endless stream of its frames with loop_no and tick.

    Frames of one animation are few; the stream's ticks meet them by frame_no.
    """
    count = frames.select("frame_no").distinct().count()
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    placed = ticks.select(
        F.col("timestamp").alias("tick"), (F.col("value") % count).cast("int").alias("frame_no"),
        F.expr(f"CAST(value DIV {count} AS INT)").alias("loop_no"),
    )
    return placed.join(frames.drop("loop_no"), "frame_no")
