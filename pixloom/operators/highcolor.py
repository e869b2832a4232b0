"""More than 256 colours in one stream: 15-bit colours, registers defined anew for every band.

A band's colours are drawn in turns of at most 255: a turn defines its colours,
draws their pixels and returns to the start of the band for the next turn.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pixloom.operators import bandcodec
from pixloom.operators.bandcodec import Style

TURN = 255

#: By kernel what is added to the lost low bits, rows and columns at the edge without diffusion, and
#: (rows down, columns right, numerator, denominator) of each share.  The first kernel gives 5/16 to the right and nothing
#: below on the right.
KERNELS: dict[str, tuple[int, int, int, tuple[tuple[int, int, int, int], ...]]] = {
    "none": (0, 0, 0, ()),
    "floyd-steinberg": (0, 1, 1, ((0, 1, 5, 16), (1, -1, 3, 16), (1, 0, 5, 16))),
    "atkinson": (4, 2, 2, ((0, 1, 1, 8), (0, 2, 1, 8), (1, -1, 1, 8), (1, 0, 1, 8), (1, 1, 1, 8), (2, 0, 1, 8))),
    "jarvis": (4, 2, 2, (
        (0, 1, 7, 48), (0, 2, 5, 48), (1, -2, 3, 48), (1, -1, 5, 48), (1, 0, 7, 48), (1, 1, 5, 48), (1, 2, 3, 48),
        (2, -2, 1, 48), (2, -1, 3, 48), (2, 0, 5, 48), (2, 1, 3, 48), (2, 2, 1, 48),
    )),
    "stucki": (4, 2, 2, (
        (0, 1, 8, 48), (0, 2, 4, 48), (1, -2, 2, 48), (1, -1, 4, 48), (1, 0, 8, 48), (1, 1, 4, 48), (1, 2, 2, 48),
        (2, -2, 1, 48), (2, -1, 2, 48), (2, 0, 4, 48), (2, 1, 2, 48), (2, 2, 1, 48),
    )),
    "burkes": (2, 1, 2, ((0, 1, 4, 16), (0, 2, 2, 16), (1, -2, 1, 16), (1, -1, 2, 16), (1, 0, 4, 16), (1, 1, 2, 16), (1, 2, 1, 16))),
}
MASKS = ("additive", "xor")


def mask(kind: str, width: int, height: int) -> np.ndarray:
    """rows x columns x 3 of what an ordered mask adds to 8-bit samples."""
    y, x, c = np.ogrid[:height, :width, :3]
    if kind == "additive":
        return (((x + c * 17 + y * 236) * 119 & 255) - 128) / 256.0
    return ((((x + c * 17) ^ (y * 236)) * 1234 & 511) - 128) / 512.0


def dither15(rasters: np.ndarray, kernel: str = "none") -> np.ndarray:
    """Five bits a sample (low bits zero) of pictures x rows x columns x 3, the lost bits spread by a kernel or mask."""
    n, height, width, _ = rasters.shape
    if kernel in MASKS:
        return np.clip(rasters + mask(kernel, width, height)[None], 0, 255).astype(np.int64) & 0xF8
    plus, low_rows, low_columns, shares = KERNELS[kernel]
    data = rasters.reshape(n, -1, 3).astype(np.int64)
    for pos in range(width * height) if shares else ():
        y, x = divmod(pos, width)
        if x >= width - low_columns or y >= height - low_rows:
            continue
        lost = (data[:, pos] & 7) + plus
        for down, right, num, den in shares:
            to = pos + down * width + right
            data[:, to] = np.minimum(data[:, to] + lost * num // den, 255)
    return (data & 0xF8).reshape(rasters.shape)


def encode_high(raster: np.ndarray, kernel: str = "none", style: Style = Style()) -> bytes:
    """A stream of a raster's 15-bit colours."""
    height, width, _ = raster.shape
    five = dither15(raster[None], kernel)[0]
    bucket = five[..., 0] << 7 | five[..., 1] << 2 | five[..., 2] >> 3
    start = ("\x90" if style.eight_bit else "\x1bP") if style.envelope else ""
    stop = ("\x9c" if style.eight_bit else "\x1b\\") if style.envelope else ""
    out = [f'{start}q"1;1;{width};{height}']
    for top in range(0, height, 6):
        band = bucket[top : top + 6]
        colours = np.unique(band)
        if top:
            out.append("-")
        for at in range(0, len(colours), TURN):
            part = colours[at : at + TURN]
            rgb = np.stack([(part >> s & 31) << 3 for s in (10, 5, 0)], axis=1)
            place = np.minimum(np.searchsorted(part, band), len(part) - 1)
            indices = np.where(part[place] == band, place, TURN)
            if at:
                out.append("$")
            out += [bandcodec.colour_definitions(rgb, style), bandcodec.body(indices, len(part), Style(limit_255=style.limit_255))]
    out.append(stop)
    return "".join(out).encode("latin-1")


def encode_high_frames(frames: DataFrame, kernel: str = "none", style: Style = Style()) -> DataFrame:
    """image_id and data of frames with packed RGB pixels."""
    if kernel not in KERNELS and kernel not in MASKS:
        raise ValueError(f"unknown kernel {kernel!r}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                encode_high(np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"], 3), kernel, style) for r in batch.to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["image_id", "data"])

    return frames.select("image_id", "width", "height", "pixels").mapInArrow(run, "image_id long, data binary")
