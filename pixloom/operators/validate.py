"""Checks of frames as columns: a status and a message instead of an exception."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pixloom.operators.geometry import LIMIT

#: Colours of a palette.
PALETTE_MIN, PALETTE_MAX = 2, 256


def frame_message(width: Column, height: Column, ncolors: Column | None = None) -> Column:
    """What is wrong with a frame's measures; null if nothing is."""
    chain = (
        F.when(width.isNull() | height.isNull(), "no size").when((width <= 0) | (height <= 0), "a side is not positive")
        .when((width > LIMIT) | (height > LIMIT), "a side is too long")
    )
    if ncolors is not None:
        chain = chain.when((ncolors < PALETTE_MIN) | (ncolors > PALETTE_MAX), "a palette has 2 to 256 colours")
    return chain


def with_status(frames, width: str = "width", height: str = "height", ncolors: str | None = None):
    """Adds status (0 or 1) and message; rows are kept."""
    message = frame_message(F.col(width), F.col(height), F.col(ncolors) if ncolors else None)
    return frames.withColumn("message", message).withColumn("status", F.when(F.col("message").isNull(), 0).otherwise(1).cast("long"))
