"""Mapping pixels to palettes: lookup joins, nearest colours, ordered masks, palette compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixloom.functions.color import RGB, bucket15, distance, mask_additive, mask_xor, masked

PALETTE_LIMIT = 256  # colours of one palette: what a nearest-colour expression compares

#: 16 colours of a terminal, in per cent.
TERMINAL_16 = (
    (0, 0, 0), (20, 20, 80), (80, 13, 13), (20, 80, 20), (80, 20, 80), (20, 80, 80), (80, 80, 20), (53, 53, 53),
    (26, 26, 26), (33, 33, 60), (60, 26, 26), (33, 60, 33), (60, 33, 60), (33, 60, 60), (60, 60, 33), (80, 80, 80),
)

#: Grays of a monochrome terminal, in per cent, in the order of its registers 1 to 15 and 0.
TERMINAL_GRAYS = (13, 26, 40, 6, 20, 33, 46, 0, 13, 26, 40, 6, 20, 33, 46, 0)

#: 16 basic colours.
BASIC_16 = (
    (0, 0, 0), (128, 0, 0), (0, 128, 0), (128, 128, 0), (0, 0, 128), (128, 0, 128), (0, 128, 128), (192, 192, 192),
    (128, 128, 128), (255, 0, 0), (0, 255, 0), (255, 255, 0), (0, 0, 255), (255, 0, 255), (0, 255, 255), (255, 255, 255),
)

#: Steps of the colour cube that follows them.
CUBE_STEPS = (0, 95, 135, 175, 215, 255)

Palette = list[tuple[int, int, int]]


def gray_palette(bits: int) -> Palette:
    """Evenly spaced grays of 1, 2, 4 or 8 bits."""
    top = (1 << bits) - 1
    return [(v * 255 // top,) * 3 for v in range(top + 1)]


def mono_palette(light: bool = False) -> Palette:
    return gray_palette(1)[::-1] if light else gray_palette(1)


def terminal_palette() -> Palette:
    """What a decoder starts from: 16 colours, a 6 x 6 x 6 cube and 24 grays."""
    steps = [i * 51 for i in range(6)]
    named = [tuple((v * 255 + 50) // 100 for v in c) for c in TERMINAL_16]
    return [*named, *[(r, g, b) for r in steps for g in steps for b in steps], *[(i * 11,) * 3 for i in range(24)]]


def cube_palette() -> Palette:
    """16 basic colours, a 6 x 6 x 6 cube and 24 grays from 8 in steps of 10."""
    cube = [(r, g, b) for r in CUBE_STEPS for g in CUBE_STEPS for b in CUBE_STEPS]
    return [*BASIC_16, *cube, *[(8 + 10 * i,) * 3 for i in range(24)]]


def builtin_palette(name: str) -> Palette:
    """One of the ten palettes by name."""
    made = {
        "mono": mono_palette, "monolight": lambda: mono_palette(True), "xterm16": lambda: list(BASIC_16), "xterm256": cube_palette,
        "vt340mono": lambda: [(p * 255 // 100,) * 3 for p in TERMINAL_GRAYS],
        "vt340color": lambda: [tuple(p * 255 // 100 for p in c) for c in (*TERMINAL_16[1:], TERMINAL_16[0])],
    } | {f"gray{bits}": lambda bits=bits: gray_palette(bits) for bits in (1, 2, 4, 8)}
    if name not in made:
        raise ValueError(f"unknown palette {name!r}")
    return made[name]()


BUILTIN = ("mono", "monolight", "xterm16", "xterm256", "vt340mono", "vt340color", "gray1", "gray2", "gray4", "gray8")


def expand(indexed: DataFrame, palettes: DataFrame) -> DataFrame:
    """idx to r, g, b; a picture's palette is one array (image_id, palette), so its pixels meet one row and are not spread by colour."""
    met = indexed.join(palettes.select("image_id", "palette"), "image_id")
    return met.withColumn("__c", F.get("palette", F.col("idx").cast("int"))).select(
        *[c for c in indexed.columns if c not in RGB], *[F.col(f"__c.{c}").alias(c) for c in RGB]
    )


def mono_index(sample_sum: Column, light: bool = False) -> Column:
    """Two colours by brightness: 256 of 765 is the border."""
    return F.when(sample_sum < 256 if light else sample_sum >= 256, 1).otherwise(0).cast("long")


def nearest(rgb: tuple[Column, ...], palette: Palette, red_weight: int = 1) -> Column:
    """Index of the nearest colour of a fixed palette, the lowest of equals; one expression, no join."""
    if len(palette) > PALETTE_LIMIT:
        raise ValueError(f"at most {PALETTE_LIMIT} colours")
    if red_weight > (2**31 - 1 - 2 * 255**2) // 255**2:
        raise ValueError("complexion parameter is too large")
    entries = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), *[F.lit(v).cast("long").alias(c) for v, c in zip(p, RGB)]) for i, p in enumerate(palette)])
    best = F.aggregate(
        entries, F.struct(F.lit(1 << 62).alias("d"), F.lit(-1).cast("long").alias("i")),
        lambda acc, e: F.least(acc, F.struct(distance(rgb, tuple(e[c] for c in RGB), red_weight).alias("d"), e["i"].alias("i"))),
    )
    return best["i"]


def nearest_by_bucket(pixels: DataFrame, palette: Palette, red_weight: int = 1) -> DataFrame:
    """As ``nearest``, but each 15-bit bucket of a picture takes the answer for its first pixel; needs ``pos``.

    The search runs on one row for each bucket and picture, 32768 at most, and
    is joined back by bucket.
    """
    keyed = pixels.withColumn("bucket", bucket15(*[F.col(c) for c in RGB]))
    firsts = keyed.groupBy("image_id", "bucket").agg(F.min_by(F.struct(*RGB), "pos").alias("first"))
    found = firsts.select("image_id", "bucket", nearest(tuple(F.col(f"first.{c}") for c in RGB), palette, red_weight).alias("idx"))
    return keyed.join(found, ["image_id", "bucket"]).select("image_id", "y", "x", "idx")


def quantize(pixels: DataFrame, palette: Palette, mask: str | None = None, red_weight: int = 1) -> DataFrame:
    """image_id, y, x, idx without diffusion; ``mask`` is None, "additive" or "xor"."""
    if mask:
        make = {"additive": mask_additive, "xor": mask_xor}[mask]
        pixels = pixels.withColumns({c: masked(F.col(c), make(F.col("x"), F.col("y"), k)) for k, c in enumerate(RGB)})
    total = F.col("r") + F.col("g") + F.col("b")
    if palette == mono_palette():
        idx = mono_index(total)
    elif palette == mono_palette(True):
        idx = mono_index(total, True)
    else:
        idx = nearest(tuple(F.col(c) for c in RGB), palette, red_weight)
    return pixels.select("image_id", "y", "x", idx.alias("idx"))


def renumbered(indexed: DataFrame, width: int) -> DataFrame:
    """image_id, idx and new_idx of the used colours of each picture, in the order of their first use."""
    used = indexed.groupBy("image_id", "idx").agg(F.min(F.col("y") * width + F.col("x")).alias("first"))
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("first")).cast("long") - 1
    return used.select("image_id", "idx", place.alias("new_idx"))


def compact(indexed: DataFrame, width: int) -> DataFrame:
    """The pixels with ``new_idx``, see ``renumbered``; only (picture, colour) rows are numbered and joined back."""
    return indexed.join(renumbered(indexed, width), ["image_id", "idx"])
