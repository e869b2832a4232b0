"""Value vectors for pixel formats and colour arithmetic."""

import pytest
from pyspark.sql import functions as F

from pixloom.functions import color
from pixloom.operators.geometry import target_size


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


@pytest.mark.parametrize("kind, word, pack", [
    ("RGB555", 0x479C, lambda r, g, b: r >> 3 << 10 | g >> 3 << 5 | b >> 3),
    ("RGB565", 0x479C, lambda r, g, b: r >> 3 << 11 | g >> 2 << 5 | b >> 3),
    ("BGR555", 0x23C8, lambda r, g, b: b >> 3 << 10 | g >> 3 << 5 | r >> 3),
    ("BGR565", 0x4788, lambda r, g, b: b >> 3 << 11 | g >> 2 << 5 | r >> 3),
])
def test_words(spark, kind, word, pack):
    assert pack(*one(spark, *color.unpack16(F.lit(word), kind))) == word


@pytest.mark.parametrize("kind, data, want", [
    ("RGB888", (0x46, 0xF3, 0xE5), (0x46, 0xF3, 0xE5)),
    ("BGR888", (0x46, 0xF3, 0xE5), (0xE5, 0xF3, 0x46)),
    ("RGBA8888", (0x46, 0xF3, 0xE5, 0xF0), (0x46, 0xF3, 0xE5)),
    ("ARGB8888", (0x46, 0xF3, 0xE5, 0xF0), (0xF3, 0xE5, 0xF0)),
    ("AG88", (0x47, 0x88), (0x88,) * 3),
    ("GA88", (0x47, 0x88), (0x47,) * 3),
])
def test_bytes(spark, kind, data, want):
    assert one(spark, *color.reorder([F.lit(v) for v in data], kind)) == want


def test_blend(spark):
    rgb = [color.over(F.lit(v).cast("long"), F.lit(0x32).cast("long"), F.lit(0x10).cast("long")) for v in (0x43, 0x89, 0x97)]
    assert one(spark, *rgb) == tuple((v * 0x32 + 0x10 * (0xFF - 0x32)) >> 8 for v in (0x43, 0x89, 0x97))


@pytest.mark.parametrize("kind, w, h, size", [
    ("G1", 9, 2, 4), ("G2", 5, 3, 6), ("G4", 3, 4, 8), ("PAL1", 17, 1, 3), ("RGB888", 2, 3, 18), ("RGB888", 0, 3, 0),
    ("PAL2", 5, 3, 6), ("PAL4", 3, 4, 8),
])
def test_frame_bytes(spark, kind, w, h, size):
    assert one(spark, color.frame_bytes(kind, F.lit(w), F.lit(h))) == (size,)


@pytest.mark.parametrize("spec, want", [
    ("#f0a", (0xF0, 0, 0xA0)), ("#123456", (0x12, 0x34, 0x56)), ("#123456789", (0x12, 0x45, 0x78)), ("#111122223333", (0x11, 0x22, 0x33)),
    ("rgb:f/80/123", (0xF0, 0x80, 0x12)), ("rgb:ffff/0/0", (0xFF, 0, 0)), ("navy", (0, 0, 128)), ("#12", None), ("rgb:1/2", None), ("nothing", None), ("", None),
])
def test_colour_specs(spark, spec, want):
    got = one(spark, color.parse_colour(F.lit(spec), {"navy": (0, 0, 128)}))[0]
    assert (tuple(got) if got else None) == want


def test_target_sizes():
    assert target_size(600, 450, "200%", "200%") == (1200, 900)
    assert target_size(600, 450, 100) == (100, 75)
    assert target_size(7, 3, 5) == (5, 3)  # the other side is rounded up
    assert target_size(600, 450) == (600, 450)
