"""From frames to streams in one plan: background, crop, size, palette, diffusion, encoding.

``Encoder`` holds the options; unset ones are chosen as said beside them.
Frames of any mix of sizes are mapped over one by one, since each stage needs
the whole picture and nothing of any other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pixloom.operators import bandcodec, diffuse, highcolor, palette
from pixloom.operators.bandcodec import Style
from pixloom.operators.geometry import Crop, target_size
from pixloom.operators.histogram import COUNT_CAP, SAMPLE_CAPS
from pixloom.operators.quantize import BUILTIN, builtin_palette, mono_palette
from pixloom.plans.kernels_array import resize_array


@dataclass(frozen=True)
class Encoder:
    """Options of the encoding; at most one of high_colour, monochrome, mapfile and builtin.

    ``mapfile`` is a palette, see ``palette_from_file``.
    """

    colours: int = 256
    high_colour: bool = False  # 15-bit colours, as many as there are
    monochrome: bool = False
    invert: bool = False
    mapfile: tuple[tuple[int, int, int], ...] | None = None
    builtin: str | None = None
    diffusion: str = "auto"  # a kernel, or an ordered mask
    red_weight: int = 1  # complexion
    largest: str = "auto"  # norm
    representative: str = "auto"  # center
    quality: str = "auto"  # high up to 8 colours, else low
    width: int | str | None = None
    height: int | str | None = None
    resampling: str = "bilinear"
    crop: Crop | None = None
    crop_first: bool = True
    static: bool = False
    background: tuple[int, int, int] | None = None  # under transparent pixels of files
    loop: str = "auto"  # see read_frames
    loops: int = 1
    macro: int | None = None  # number of a terminal macro to define
    penetrate: bool = False  # wrapped for a terminal multiplexer
    style: Style = field(default_factory=Style)

    def __post_init__(self) -> None:
        if sum((self.high_colour, self.monochrome, self.mapfile is not None, self.builtin is not None)) > 1:
            raise ValueError("high colour, monochrome, mapfile and builtin palettes exclude each other")
        if self.penetrate and self.style.eight_bit:
            raise ValueError("a multiplexer passes on streams of seven bits only")
        if self.red_weight < 1:
            raise ValueError("the weight of red is 1 at least")
        if not 2 <= self.colours <= 256:
            raise ValueError("a palette has 2 to 256 colours")
        if self.diffusion != "auto" and self.diffusion not in diffuse.KERNELS and self.diffusion not in diffuse.MASKS:
            raise ValueError(f"unknown diffusion {self.diffusion!r}")
        if self.builtin is not None and self.builtin not in BUILTIN:
            raise ValueError(f"unknown palette {self.builtin!r}")

    # --- one picture -----------------------------------------------------------

    def geometry(self, raster: np.ndarray) -> np.ndarray:
        def cropped(r: np.ndarray) -> np.ndarray:
            c = self.crop
            if c is None or c.x >= r.shape[1] or c.y >= r.shape[0] or c.width <= 0 or c.height <= 0:
                return r
            return r[c.y : c.y + c.height, c.x : c.x + c.width]

        if self.crop_first:
            raster = cropped(raster)
        size = target_size(raster.shape[1], raster.shape[0], self.width, self.height)
        raster = resize_array(raster, *size, self.resampling)
        return raster if self.crop_first else cropped(raster)

    def choose_palette(self, raster: np.ndarray) -> tuple[np.ndarray, int]:
        """The palette, and how many colours the picture has in 15 bits."""
        quality = self.quality if self.quality != "auto" else "high" if self.colours <= 8 else "low"
        flat = raster.reshape(-1, 3).astype(np.int64)
        flat = flat[:: max(1, len(flat) // SAMPLE_CAPS[quality])]
        bucket = flat[:, 0] >> 3 << 10 | flat[:, 1] >> 3 << 5 | flat[:, 2] >> 3
        found, first, counts = np.unique(bucket, return_index=True, return_counts=True)
        order = np.argsort(first)
        if self.monochrome:
            return np.array(mono_palette(self.invert)), len(found)
        if self.mapfile is not None:
            return np.array(self.mapfile), len(found)
        if self.builtin:
            return np.array(builtin_palette(self.builtin)), len(found)
        colours = np.stack([(found[order] >> s & 31) << 3 for s in (10, 5, 0)], axis=1)
        largest = "norm" if self.largest == "auto" else self.largest
        rep = "center" if self.representative == "auto" else self.representative
        return palette.cut(colours, np.minimum(counts[order], COUNT_CAP), self.colours, largest, rep), len(found)

    def encode(self, raster: np.ndarray) -> bytes:
        raster = self.geometry(raster)
        height, width, _ = raster.shape
        if self.high_colour:
            kernel = "floyd-steinberg" if self.diffusion == "auto" else self.diffusion
            return self.enveloped(highcolor.encode_high(raster, kernel, self.style))
        colours, before = self.choose_palette(raster)
        kernel = diffuse.auto_kernel(len(colours)) if self.diffusion == "auto" else self.diffusion
        own = not self.monochrome and not self.builtin and self.mapfile is None
        if before <= len(colours) and own:
            kernel = "none"
        indices = diffuse.diffuse(
            raster.reshape(1, -1, 3), colours[None], np.array([len(colours)]), width, height, kernel, self.quality != "full", self.red_weight
        )[0]
        if own:  # colours in the order of their first use, others left out
            used, first, at = np.unique(indices, return_index=True, return_inverse=True)
            place = np.argsort(np.argsort(first))
            colours, indices = colours[used[np.argsort(first)]], place[at]
        return self.enveloped(bandcodec.encode(indices.reshape(height, width), colours, self.style))

    def enveloped(self, data: bytes) -> bytes:
        if self.macro is not None:
            data = b"\x1bP%d;0;1!z" % self.macro + data.hex().encode() + b"\x1b\\"
        return bandcodec.wrapped(data) if self.penetrate else data

    @staticmethod
    def invoke(macro: int) -> bytes:
        """What makes a terminal run the macro of that number."""
        return b"\x1b[%d*z" % macro

    # --- files ---------------------------------------------------------------------

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        """Frames of the files below a path, with the options for reading."""
        from pixloom.sources.loader import read_frames

        return read_frames(spark, path, self.background, self.static, self.loops, self.loop)

    def encode_files(self, spark: SparkSession, path: str) -> DataFrame:
        return self.encode_frames(self.read(spark, path))

    # --- a table of frames ---------------------------------------------------------

    def encode_frames(self, frames: DataFrame) -> DataFrame:
        """source, loop_no, frame_no, delay, data, message of each frame (see ``sources.loader``)."""
        names = ["source", "loop_no", "frame_no", "delay", "data", "message"]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pixloom.sources.loader import raster_of

            for batch in batches:
                for at in range(batch.num_rows):  # one picture is unpacked at a time
                    (row,) = batch.slice(at, 1).to_pylist()
                    data, message = None, row["message"]
                    if message is None:
                        try:
                            if None in (row["width"], row["height"], row["pixels"]):
                                raise ValueError("width, height and pixels are needed")
                            data = self.encode(raster_of(row))
                        except (ValueError, TypeError, IndexError) as e:
                            message = str(e)
                    values = [row["source"], row["loop_no"], row["frame_no"], row["delay"], data, message]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        chosen = frames.where("frame_no = 0 AND loop_no = 0") if self.static else frames
        return chosen.mapInArrow(run, "source string, loop_no int, frame_no int, delay int, data binary, message string")


def palette_from_file(spark: SparkSession, path: str, colours: int = 256, background: tuple[int, int, int] | None = None) -> tuple[tuple[int, int, int], ...]:
    """The palette that a picture's first frame has, or one made for it."""
    from pixloom.sources.loader import raster_of, read_frames

    row = read_frames(spark, path, background, static=True).where("loop_no = 0 AND frame_no = 0").first()
    if row is None:
        raise ValueError("the palette's file is empty")
    if row["message"] is not None:
        raise ValueError(row["message"])
    if row["pixelformat"] == "PAL8":
        made = np.frombuffer(row["palette"], np.uint8).reshape(-1, 3)
    elif row["pixelformat"] == "G8":
        made = np.array(builtin_palette("gray8"))
    else:
        made, _ = Encoder(colours=colours, quality="high", largest="norm", representative="center").choose_palette(raster_of(row))
    return tuple(tuple(map(int, c)) for c in made)
