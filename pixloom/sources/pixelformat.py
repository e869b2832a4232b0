"""Raw rasters of any pixel format: unpacking, reordering, and frames from bytes.

Words of 16 bits are stored high byte first and give their bits as the high ones
of a sample; alpha is dropped; pixels of 1, 2 or 4 bits stand first pixel first
in the high bits, with rows that end on a byte.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pixloom.functions.color import BITS_PER_PIXEL, BYTES_PER_PIXEL

SCHEMA = "source string, width int, height int, pixelformat string, pixels binary, palette binary, message string"
_KINDS = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.string()]


def raster_bytes(kind: str, width: int, height: int) -> int:
    if kind in BITS_PER_PIXEL:
        return (width * BITS_PER_PIXEL[kind] + 7) // 8 * height
    if kind not in BYTES_PER_PIXEL:
        raise ValueError(f"unknown pixel format {kind!r}")
    return width * BYTES_PER_PIXEL[kind] * height


def normalise(data: bytes, width: int, height: int, kind: str) -> tuple[np.ndarray, str]:
    """A raster as RGB888 (rows x columns x 3), or as PAL8 or G8 (rows x columns) for formats of whole or part bytes."""
    if width <= 0 or height <= 0:
        raise ValueError("a raster has at least one pixel")
    size = raster_bytes(kind, width, height)
    if len(data) < size:
        raise ValueError(f"{len(data)} bytes are too few, a raster of {width} x {height} in {kind} has {size}")
    flat = np.frombuffer(data, np.uint8, size)
    if kind in BITS_PER_PIXEL:
        depth = BITS_PER_PIXEL[kind]
        bits = np.unpackbits(flat.reshape(height, -1), axis=1)
        bits = bits.reshape(height, -1, depth)[:, :width]
        values = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2).astype(np.uint8)
        return values, "PAL8" if kind.startswith("PAL") else "G8"
    planes = flat.reshape(height, width, -1)
    if kind == "PAL8":
        return planes[:, :, 0], kind
    letters = kind.rstrip("0123456789")
    if kind.endswith(("555", "565")):
        word = planes[:, :, 0].astype(np.int64) << 8 | planes[:, :, 1]
        shift, mask, up = (11, 63, 2) if kind.endswith("565") else (10, 31, 3)
        parts = ((word >> shift & 31) << 3, (word >> 5 & mask) << up, (word & 31) << 3)
        return np.stack(parts if letters == "RGB" else parts[::-1], axis=2).astype(np.uint8), "RGB888"
    at = [letters.index("G")] * 3 if "R" not in letters else [letters.index(c) for c in "RGB"]
    return np.ascontiguousarray(planes[:, :, at]), "RGB888"


def rgb_of(data: bytes, width: int, height: int, kind: str, palette: bytes | None = None) -> np.ndarray:
    """A raster as RGB888; indices meet their palette, grays of few bits are spread over 0 to 255."""
    raster, made = normalise(data, width, height, kind)
    if made == "RGB888":
        return raster
    if made == "G8":
        top = (1 << BITS_PER_PIXEL[kind]) - 1
        return np.repeat((raster.astype(np.int64) * 255 // top).astype(np.uint8)[:, :, None], 3, axis=2)
    colours = np.frombuffer(palette or b"", np.uint8)
    if not len(colours) or len(colours) % 3:
        raise ValueError("indices need a palette")
    if int(raster.max()) >= len(colours) // 3:
        raise ValueError("an index lies beyond the palette")
    return colours.reshape(-1, 3)[raster]


def raw_frames(raw: DataFrame, expand: bool = True) -> DataFrame:
    """Frames of a table source, width, height, pixelformat, pixels, palette (null for formats without one).

    With ``expand`` every frame becomes RGB888, else indices and grays of few
    bits become one byte each.  A row that makes no frame keeps a message.
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(batch.num_rows):
                (r,) = batch.slice(start, 1).to_pylist()
                row = [r["source"], r["width"], r["height"], None, None, r["palette"], None]
                try:
                    if None in (r["width"], r["height"], r["pixelformat"], r["pixels"]):
                        raise ValueError("width, height, pixelformat and pixels are needed")
                    if expand:
                        raster, kind = rgb_of(r["pixels"], r["width"], r["height"], r["pixelformat"], r["palette"]), "RGB888"
                    else:
                        raster, kind = normalise(r["pixels"], r["width"], r["height"], r["pixelformat"])
                    row[3:6] = kind, raster.tobytes(), r["palette"] if kind == "PAL8" else None
                except ValueError as e:
                    row[6] = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _KINDS)], names=names)

    return raw.selectExpr(
        "CAST(source AS string) AS source", "CAST(width AS int) AS width", "CAST(height AS int) AS height", "pixelformat", "pixels", "palette"
    ).mapInArrow(run, SCHEMA)
