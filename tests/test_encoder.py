"""The encoder's options, and arrays against the DataFrame form."""

import numpy as np
import pytest

from pixloom.operators import geometry
from pixloom.operators.bandcodec import decode, encode
from pixloom.operators.geometry import Crop
from pixloom.plans.encoder import Encoder
from pixloom.plans.kernels_array import KERNELS, resize_array

RNG = np.random.default_rng(9)


@pytest.mark.parametrize("kernel", ["nearest", *KERNELS])
@pytest.mark.parametrize("to", [(5, 12), (12, 3)])
def test_resize_forms_agree(spark, kernel, to):
    raster = RNG.integers(0, 256, (6, 8, 3))
    rows = [(1, y, x, *map(int, raster[y, x])) for y in range(6) for x in range(8)]
    df = spark.createDataFrame(rows, "image_id long, y long, x long, r long, g long, b long")
    got = np.zeros((to[1], to[0], 3), int)
    for r in geometry.resize(df, 8, 6, *to, kernel).collect():
        got[r["y"], r["x"]] = (r["r"], r["g"], r["b"])
    assert (got == resize_array(raster.astype(np.uint8), *to, kernel)).all()


def test_nearest_doubling_of_a_stream():
    raster, palette = decode(b'\x1bPq"1;1;1;1!6~\x1b\\')
    made = Encoder(width="200%", height="200%", resampling="nearest").encode(palette_raster(raster))
    assert made.endswith(b"#0!12~-!12~\x1b\\")


def palette_raster(indices):
    from pixloom.operators.quantize import terminal_palette

    return np.array(terminal_palette(), np.uint8)[indices]


def test_options():
    raster = RNG.integers(0, 256, (20, 30, 3)).astype(np.uint8)
    indices, colours = decode(Encoder(colours=16).encode(raster))
    assert indices.shape == (20, 30) and indices.max() < 16
    assert decode(Encoder(crop=Crop(5, 4, 2, 1)).encode(raster))[0].shape == (4, 5)
    assert decode(Encoder(crop=Crop(5, 4, 2, 1), crop_first=False, width=10, height=10).encode(raster))[0].shape == (4, 5)
    assert decode(Encoder(crop=Crop(5, 4, 99, 1)).encode(raster))[0].shape == (20, 30)
    assert set(np.unique(decode(Encoder(monochrome=True).encode(raster))[0])) == {0, 1}
    assert decode(Encoder(builtin="gray4").encode(raster))[0].max() <= 15
    assert Encoder(macro=3).encode(raster).startswith(b"\x1bP3;0;1!z1b50")
    few = (RNG.integers(0, 2, (6, 6, 1)) * np.array([248, 8, 16])).astype(np.uint8)
    assert len(np.unique(decode(Encoder().encode(few))[0])) == 2
    for bad in ({"monochrome": True, "builtin": "gray1"}, {"colours": 1}, {"diffusion": "x"}, {"builtin": "x"}):
        with pytest.raises(ValueError):
            Encoder(**bad)


def test_files_to_streams(spark, tmp_path):
    from pixloom.sources.loader import read_frames

    (tmp_path / "a.ppm").write_bytes(b"P6 2 1 255\n\0\0\0\xf8\xf8\xf8")
    (tmp_path / "b.six").write_bytes(encode(np.array([[0, 1]]), np.array([[0, 0, 0], [255, 255, 255]])))
    (tmp_path / "c.png").write_bytes(b"\x89PNG\r\n\x1a\nbroken")
    rows = {r["source"].rsplit("/", 1)[1]: r for r in Encoder().encode_frames(read_frames(spark, str(tmp_path))).collect()}
    assert decode(rows["a.ppm"]["data"])[0].tolist() == [[0, 1]] and decode(rows["b.six"]["data"])[0].tolist() == [[0, 1]]
    assert rows["c.png"]["data"] is None and rows["c.png"]["message"]
