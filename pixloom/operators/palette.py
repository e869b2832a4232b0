"""Adaptive palettes: median cut over a histogram, one picture at a time.

A histogram has at most 32768 colours, so one picture's list is bounded and
travels as one row.  Equal samples are ordered by bucket and boxes of equal
weight keep their order, where other implementations leave the order open.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Luminosity weights of the planes.
LUMINOSITY = np.array([0.2989, 0.5866, 0.1145])
REPRESENTATIVES = ("center", "mean", "pixel_mean")


def cut(colours: np.ndarray, counts: np.ndarray, wanted: int, largest: str = "norm", rep: str = "center") -> np.ndarray:
    """At most ``wanted`` colours for a histogram (colours: n x 3 in order of first use)."""
    if len(colours) <= wanted:
        return colours
    boxes = [np.arange(len(colours))]
    while len(boxes) < wanted:
        at = next((i for i, b in enumerate(boxes) if len(b) > 1), None)
        if at is None:
            break
        box = boxes[at]
        spread = np.ptp(colours[box], axis=0)
        plane = int(np.argmax(spread * LUMINOSITY if largest == "luminosity" else spread))
        own = colours[box]
        box = box[np.lexsort((own[:, 2], own[:, 1], own[:, 0], own[:, plane]))]
        running = np.cumsum(counts[box])
        middle = min(len(box) - 1, 1 + int(np.searchsorted(running, running[-1] // 2, "left")))
        boxes[at] = box[:middle]
        boxes.append(box[middle:])
        boxes.sort(key=lambda b: -int(counts[b].sum()))
    if rep == "center":
        return np.array([(colours[b].min(axis=0) + colours[b].max(axis=0)) // 2 for b in boxes])
    if rep == "mean":
        return np.array([colours[b].sum(axis=0) // len(b) for b in boxes])
    if rep == "pixel_mean":
        return np.array([(colours[b] * counts[b, None]).sum(axis=0) // counts[b].sum() for b in boxes])
    raise ValueError(f"unknown representative {rep!r}")


def median_cut(hist: DataFrame, wanted: int, largest: str = "norm", rep: str = "center") -> DataFrame:
    """image_id, palette (packed r, g, b), ncolors, origcolors of every picture of a histogram."""
    if not 2 <= wanted <= 256:
        raise ValueError("a palette has 2 to 256 colours")
    if rep not in REPRESENTATIVES or largest not in ("norm", "luminosity"):
        raise ValueError("unknown method")
    lists = hist.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("first_pos", "bucket", "n"))).alias("h"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            palettes, sizes, before = [], [], []
            for entries in batch.column(1):
                bucket = entries.values.field("bucket").to_numpy()
                counts = entries.values.field("n").to_numpy()
                colours = np.stack([(bucket >> s & 31) << 3 for s in (10, 5, 0)], axis=1)
                made = cut(colours, counts, wanted, largest, rep)
                palettes.append(made.astype(np.uint8).tobytes())
                sizes.append(len(made))
                before.append(len(colours))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(palettes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(before, pa.int64())],
                names=["image_id", "palette", "ncolors", "origcolors"],
            )

    return lists.mapInArrow(run, "image_id long, palette binary, ncolors long, origcolors long")
