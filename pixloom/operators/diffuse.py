"""Error diffusion: raster-order folds, run for many pictures of one size at a time.

Within a picture each pixel depends on those before it; across pictures nothing
does.  So pictures of equal size are stacked and the loop over positions works
on all of them with array operations.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values: (rows down, columns right, numerator, denominator) of each kernel.
KERNELS: dict[str, tuple[tuple[int, int, int, int], ...]] = {
    "none": (),
    "floyd-steinberg": ((0, 1, 7, 16), (1, -1, 3, 16), (1, 0, 5, 16), (1, 1, 1, 16)),
    "atkinson": ((0, 1, 1, 8), (0, 2, 1, 8), (1, -1, 1, 8), (1, 0, 1, 8), (1, 1, 1, 8), (2, 0, 1, 8)),
    "jarvis": (
        (0, 1, 7, 48), (0, 2, 5, 48), (1, -2, 3, 48), (1, -1, 5, 48), (1, 0, 7, 48), (1, 1, 5, 48), (1, 2, 3, 48),
        (2, -2, 1, 48), (2, -1, 3, 48), (2, 0, 5, 48), (2, 1, 3, 48), (2, 2, 1, 48),
    ),
    "stucki": (
        (0, 1, 1, 6), (0, 2, 1, 12), (1, -2, 1, 24), (1, -1, 1, 12), (1, 0, 1, 6), (1, 1, 1, 12), (1, 2, 1, 24),
        (2, -2, 1, 48), (2, -1, 1, 24), (2, 0, 1, 12), (2, 1, 1, 24), (2, 2, 1, 48),
    ),
    "burkes": ((0, 1, 1, 4), (0, 2, 1, 8), (1, -2, 1, 16), (1, -1, 1, 8), (1, 0, 1, 4), (1, 1, 1, 8), (1, 2, 1, 16)),
}
STACK_BYTES = 64 << 20  # of distances held at a time


def spreads(kernel: str, x: int, y: int, width: int, height: int) -> bool:
    """Whether the pixel passes its error on; targets are places in the flat raster, without a column guard."""
    pos = y * width + x
    if kernel == "floyd-steinberg":
        return x < width - 1 and y < height - 1
    if kernel == "atkinson":
        return y < height - 2
    if kernel in ("jarvis", "stucki"):
        return width >= 2 and pos < (height - 2) * width - 2
    if kernel == "burkes":
        return width >= 2 and pos < (height - 1) * width - 2
    return False


def auto_kernel(ncolors: int) -> str:
    return "floyd-steinberg" if ncolors > 16 else "atkinson"


MASKS = ("additive", "xor")


def mask(kind: str, width: int, height: int) -> np.ndarray:
    """rows x columns x 3 of an ordered mask, in -1..1."""
    y, x, c = np.ogrid[:height, :width, :3]
    if kind == "additive":
        return ((x + c * 67 + y * 236) * 119 & 255) / 128.0 - 1.0
    return (((x + c * 29) ^ y * 149) * 1234 & 511) / 256.0 - 1.0


def diffuse(pixels: np.ndarray, palettes: np.ndarray, sizes: np.ndarray, width: int, height: int, kernel: str, cached: bool = False,
            red_weight: int = 1) -> np.ndarray:
    """Indices (pictures x pixels) for rasters (pictures x pixels x 3) and palettes (pictures x colours x 3).

    ``kernel`` may be an ordered mask too, which is added to the pixels before
    their colours are looked up.  ``cached`` lets each 15-bit bucket keep the
    answer of its first pixel; ``red_weight`` multiplies the red distance.
    """
    data = pixels.astype(np.int64)
    if kernel in MASKS:
        data = np.clip((data + mask(kernel, width, height).reshape(1, -1, 3) * 32.0).astype(np.int64), 0, 255)
        kernel = "none"
    if len(data) == 1:
        return _diffuse_one(data[0], palettes[0, : sizes[0]].astype(np.int64), width, height, kernel, cached, red_weight)[None]
    weights = np.array([red_weight, 1, 1])
    palettes = palettes.astype(np.int64)
    n, colours = len(data), palettes.shape[1]
    beyond = np.arange(colours)[None, :] >= sizes[:, None]
    out = np.zeros((n, width * height), np.uint8)
    rows = np.arange(n)
    sums = palettes.sum(axis=2)
    mono_dark = (sizes == 2) & (sums[:, 0] == 0) & (sums[:, min(1, colours - 1)] == 765)
    mono_light = (sizes == 2) & (sums[:, 0] == 765) & (sums[:, min(1, colours - 1)] == 0)
    cache = np.full((n, 1 << 15), -1, np.int16) if cached else None
    for pos in range(width * height):
        here = data[:, pos]
        away = ((here[:, None, :] - palettes) ** 2 * weights).sum(axis=2)
        away[beyond] = 1 << 40
        best = away.argmin(axis=1)
        bright = here.sum(axis=1) >= 256
        best = np.where(mono_dark, bright, np.where(mono_light, ~bright, best))
        if cache is not None:
            bucket = here[:, 0] >> 3 << 10 | here[:, 1] >> 3 << 5 | here[:, 2] >> 3
            held = cache[rows, bucket]
            best = np.where((held >= 0) & ~mono_dark & ~mono_light, held, best)
            cache[rows, bucket] = best
        out[:, pos] = best
        y, x = divmod(pos, width)
        if not spreads(kernel, x, y, width, height):
            continue
        error = here - palettes[rows, best]
        for down, right, num, den in KERNELS[kernel]:
            share = np.sign(error) * (np.abs(error) * num // den)
            to = pos + down * width + right
            data[:, to] = np.clip(data[:, to] + share, 0, 255)
    return out


def _diffuse_one(data: np.ndarray, palette: np.ndarray, width: int, height: int, kernel: str, cached: bool, red_weight: int) -> np.ndarray:
    """The same for one picture, sample by sample: whole numbers of Python are faster than arrays of one element."""
    colours = palette.tolist()
    dark, light = colours == [[0, 0, 0], [255, 255, 255]], colours == [[255, 255, 255], [0, 0, 0]]
    weights = np.array([red_weight, 1, 1])
    if kernel == "none" and not cached and not dark and not light:  # nothing depends on anything
        out = np.empty(len(data), np.uint8)
        step = max(1, STACK_BYTES // (24 * len(colours)))
        for at in range(0, len(data), step):
            out[at : at + step] = ((data[at : at + step, None, :] - palette) ** 2 * weights).sum(axis=2).argmin(axis=1)
        return out
    planes = [data[:, c].tolist() for c in range(3)]
    red, green, blue = planes
    known: dict[int, int] = {}
    out = bytearray(len(red))
    shares = [(down * width + right, num, den) for down, right, num, den in KERNELS[kernel]]
    pos = 0
    for y in range(height):
        for x in range(width):
            r, g, b = red[pos], green[pos], blue[pos]
            if dark or light:
                best = int((r + g + b >= 256) ^ light)
            else:
                key = r >> 3 << 10 | g >> 3 << 5 | b >> 3 if cached else r << 16 | g << 8 | b
                best = known.get(key, -1)
                if best < 0:
                    best = known[key] = int((((r, g, b) - palette) ** 2 * weights).sum(axis=1).argmin())
            out[pos] = best
            if shares and spreads(kernel, x, y, width, height):
                for plane, was, now in zip(planes, (r, g, b), colours[best]):
                    error = was - now
                    if error > 0:
                        for to, num, den in shares:
                            v = plane[pos + to] + error * num // den
                            plane[pos + to] = v if v < 255 else 255
                    elif error:
                        for to, num, den in shares:
                            v = plane[pos + to] - (-error * num // den)
                            plane[pos + to] = v if v > 0 else 0
            pos += 1
        if not cached and len(known) > 1 << 20:
            known.clear()
    return np.frombuffer(bytes(out), np.uint8)


def diffuse_frames(frames: DataFrame, kernel: str = "auto", cached: bool = True, skip_if_fits: bool = True) -> DataFrame:
    """image_id, width, height, indices, palette, ncolors of frames that carry a palette, ncolors and origcolors.

    "auto" takes Floyd-Steinberg above 16 colours, else Atkinson; pictures whose
    colours all fit their palette are not diffused.
    """
    if kernel != "auto" and kernel not in KERNELS and kernel not in MASKS:
        raise ValueError(f"unknown kernel {kernel!r}")
    names = ["image_id", "width", "height", "indices", "palette", "ncolors"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            groups: dict[tuple, list[int]] = {}
            for i, r in enumerate(rows):
                chosen = auto_kernel(r["ncolors"]) if kernel == "auto" else kernel
                if skip_if_fits and r["origcolors"] <= r["ncolors"]:
                    chosen = "none"
                groups.setdefault((r["width"], r["height"], chosen), []).append(i)
            made: dict[int, bytes] = {}
            for (width, height, chosen), members in groups.items():
                most = max(rows[i]["ncolors"] for i in members)
                step = max(1, STACK_BYTES // (most * 24 + width * height * 24 + (65536 if cached else 0)))
                for at in range(0, len(members), step):
                    part = [rows[i] for i in members[at : at + step]]
                    data = np.stack([np.frombuffer(r["pixels"], np.uint8).reshape(-1, 3) for r in part])
                    sizes = np.array([r["ncolors"] for r in part])
                    palettes = np.zeros((len(part), int(sizes.max()), 3), np.uint8)
                    for k, r in enumerate(part):
                        palettes[k, : sizes[k]] = np.frombuffer(r["palette"], np.uint8).reshape(-1, 3)
                    indices = diffuse(data, palettes, sizes, width, height, chosen, cached)
                    made.update(zip(members[at : at + step], (x.tobytes() for x in indices)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("image_id"), batch.column("width"), batch.column("height"),
                 pa.array([made[i] for i in range(len(rows))], pa.binary()), batch.column("palette"), batch.column("ncolors")],
                names=names,
            )

    return frames.select("image_id", "width", "height", "pixels", "palette", "ncolors", "origcolors").mapInArrow(
        run, "image_id long, width int, height int, indices binary, palette binary, ncolors long"
    )
