"""Colour arithmetic as Catalyst expressions.

Samples are longs of 0..255 and divisions truncate towards zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RGB = ("r", "g", "b")

#: Bytes of one pixel by format; packed formats (bits) are listed apart.
BYTES_PER_PIXEL = {
    "RGB555": 2, "RGB565": 2, "BGR555": 2, "BGR565": 2, "AG88": 2, "GA88": 2, "RGB888": 3, "BGR888": 3,
    "ARGB8888": 4, "RGBA8888": 4, "ABGR8888": 4, "BGRA8888": 4, "G8": 1, "PAL8": 1,
}
BITS_PER_PIXEL = {"G1": 1, "G2": 2, "G4": 4, "PAL1": 1, "PAL2": 2, "PAL4": 4}


def div(a: Column, b: Column | int) -> Column:
    """Integer division towards zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def clamp(c: Column, low: int = 0, high: int = 255) -> Column:
    return F.least(F.greatest(c, F.lit(low).cast("long")), F.lit(high).cast("long"))


def unpack16(value: Column, kind: str) -> tuple[Column, Column, Column]:
    """RGB555/565 and BGR555/565 words to 8-bit samples; low bits stay empty."""
    six = kind.endswith("565")
    shift, mask, up = (11, 63, 2) if six else (10, 31, 3)
    high = F.shiftleft(F.shiftright(value, shift).bitwiseAND(F.lit(31)), 3)
    middle = F.shiftleft(F.shiftright(value, 5).bitwiseAND(F.lit(mask)), up)
    low = F.shiftleft(value.bitwiseAND(F.lit(31)), 3)
    return (high, middle, low) if kind.startswith("RGB") else (low, middle, high)


def reorder(bytes_: list[Column], kind: str) -> tuple[Column, Column, Column]:
    """The r, g, b of a pixel stored byte by byte as ``kind`` (RGB888, BGRA8888, AG88 ...); alpha is dropped."""
    letters = kind.rstrip("0123456789")
    if "G" in letters and "R" not in letters:
        gray = bytes_[letters.index("G")]
        return gray, gray, gray
    return tuple(bytes_[letters.index(c)] for c in "RGB")  # type: ignore[return-value]


def frame_bytes(kind: str, width: Column, height: Column) -> Column:
    """Size of a raster; rows of packed formats end on a byte."""
    if kind in BITS_PER_PIXEL:
        return div(width * BITS_PER_PIXEL[kind] + 7, 8) * height
    return width * BYTES_PER_PIXEL[kind] * height


def sub_pixel(byte: Column, place: Column, bits: int) -> Column:
    """Pixel ``place`` of a byte that holds 8 / bits of them, first pixel in the high bits."""
    shift = (F.lit(8 - bits) - place * bits).cast("int")
    return F.call_function("shiftright", byte, shift).bitwiseAND(F.lit((1 << bits) - 1))


def over(sample: Column, alpha: Column, background: Column) -> Column:
    """Alpha blending on a background: weights a and 255 - a, then a shift by 8."""
    return F.shiftright(sample * alpha + background * (F.lit(255) - alpha), 8)


def to_percent(sample: Column) -> Column:
    return div(sample * 100 + 127, 255)


def from_percent(percent: Column) -> Column:
    return div(percent * 255 + 50, 100)


def rgb_to_hls(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Integer hue (blue at 0, red at 120, green at 240 degrees), lightness and saturation in per cent."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    spread = top - low
    light = div((top + low) * 100 + 255, 510)
    sat = F.when(spread == 0, 0).when(light < 50, div(spread * 100, top + low)).otherwise(div(spread * 100, F.lit(510) - top - low))

    def sector(start: int, a: Column, c: Column) -> Column:
        return F.lit(start) + div((a - c) * 60, spread)

    hue = (
        F.when(spread == 0, 0).when(r == top, sector(120, g, b)).when(g == top, sector(240, b, r))
        .when(r < g, sector(360, r, g)).otherwise(sector(0, r, g))
    )
    return hue.cast("long"), light.cast("long"), sat.cast("long")


def hls_to_rgb(h: Column, light: Column, sat: Column) -> tuple[Column, Column, Column]:
    """Back to 8-bit samples by way of whole per cents."""
    fold = F.abs(light / 50.0 - 1.0)
    half = sat * (F.lit(1.0) - fold) / 2.0
    top, low = light + half, light - half
    hue = F.pmod(h + 240, F.lit(360)).cast("long")
    sixth = div(hue, 60)
    up = low + (top - low) * ((hue - sixth * 60) / 60.0)
    down = low + (top - low) * (((sixth + 1) * 60 - hue) / 60.0)
    order = {0: (top, up, low), 1: (down, top, low), 2: (low, top, up), 3: (low, down, top), 4: (up, low, top), 5: (top, low, down)}
    out = []
    for c in range(3):
        value = F.when(sixth == 0, order[0][c])
        for k in range(1, 6):
            value = value.when(sixth == k, order[k][c])
        out.append(from_percent(value.cast("long")))
    return tuple(out)  # type: ignore[return-value]


def bucket15(r: Column, g: Column, b: Column) -> Column:
    """Five high bits of each sample in one number."""
    five = [F.shiftright(c, 3) for c in (r, g, b)]
    return F.shiftleft(five[0], 10).bitwiseOR(F.shiftleft(five[1], 5)).bitwiseOR(five[2])


def bucket_rgb(bucket: Column) -> tuple[Column, Column, Column]:
    return tuple(F.shiftleft(F.shiftright(bucket, s).bitwiseAND(F.lit(31)), 3) for s in (10, 5, 0))  # type: ignore[return-value]


def distance(a: tuple[Column, ...], b: tuple[Column, ...], red_weight: int = 1) -> Column:
    parts = [(x - y) * (x - y) for x, y in zip(a, b)]
    return parts[0] * red_weight + parts[1] + parts[2]


def mask_additive(x: Column, y: Column, plane: int) -> Column:
    """Ordered mask in -1..1 of the additive kind."""
    x, y = x.cast("long"), y.cast("long")
    return ((x + plane * 67 + y * 236) * 119).bitwiseAND(F.lit(255)) / 128.0 - 1.0


def mask_xor(x: Column, y: Column, plane: int) -> Column:
    x, y = x.cast("long"), y.cast("long")
    return ((x + plane * 29).bitwiseXOR(y * 149) * 1234).bitwiseAND(F.lit(511)) / 256.0 - 1.0


def masked(sample: Column, mask: Column) -> Column:
    """A sample with 32 times the mask added, cut towards zero and clamped."""
    return clamp((sample + mask * 32.0).cast("long"))


def parse_colour(spec: Column, names: dict[str, tuple[int, int, int]] | None = None) -> Column:
    """``#rgb`` of 3, 6, 9 or 12 digits, ``rgb:h/h/h`` of 1 to 4 digits each, or a name of the given table.

    A struct of r, g, b; null if the text says no colour.
    """
    spec = F.trim(spec)
    digits = F.regexp_extract(spec, r"^#([0-9A-Fa-f]+)$", 1)
    width = F.length(digits) / 3

    def number(text: Column) -> Column:
        return F.conv(text, 16, 10).cast("long")

    def hash_part(k: int) -> Column:
        return F.when(F.length(digits) == 3, number(F.substring(digits, k + 1, 1)) * 16).otherwise(
            number(F.substr(digits, (F.lit(k) * width + 1).cast("int"), F.lit(2)))
        )

    pattern = r"^rgb:([0-9A-Fa-f]{1,4})/([0-9A-Fa-f]{1,4})/([0-9A-Fa-f]{1,4})$"

    def slash_part(k: int) -> Column:
        return number(F.rpad(F.substring(F.regexp_extract(spec, pattern, k + 1), 1, 2), 2, "0"))

    named = F.lit(None).cast("struct<r:bigint,g:bigint,b:bigint>")
    if names:
        entries = [x for n, rgb in names.items() for x in (F.lit(n), F.struct(*[F.lit(v).cast("long").alias(c) for v, c in zip(rgb, RGB)]))]
        named = F.try_element_at(F.create_map(*entries), F.lower(spec))
    return (
        F.when(F.length(digits).isin(3, 6, 9, 12), F.struct(*[hash_part(k).alias(c) for k, c in enumerate(RGB)]))
        .when(F.regexp_like(spec, F.lit(pattern)), F.struct(*[slash_part(k).alias(c) for k, c in enumerate(RGB)]))
        .otherwise(named)
    )
