"""Raw rasters, plain bitmap formats, addresses, sinks and the encoder's further options."""

import http.server
import struct
import threading
import zlib

import numpy as np
import pytest

from pixloom.operators import bandcodec, diffuse, geometry, highcolor
from pixloom.operators.bandcodec import Style, decode
from pixloom.operators.quantize import BUILTIN, builtin_palette
from pixloom.plans.encoder import Encoder, palette_from_file
from pixloom.sources import bitmaps, loader, pixelformat, png, writers

RNG = np.random.default_rng(12)
PICTURE = RNG.integers(0, 256, (5, 7, 3)).astype(np.uint8)

#: Fixed vectors: format, bytes of one pixel, what becomes of them.
VECTORS = [
    ("RGB888", "46f3e5", "46f3e5"), ("BGR888", "46f3e5", "e5f346"), ("AG88", "4788", "888888"), ("GA88", "4788", "474747"),
    ("RGBA8888", "46f3e5f0", "46f3e5"), ("ARGB8888", "46f3e5f0", "f3e5f0"), ("BGRA8888", "46f3e5f0", "e5f346"), ("ABGR8888", "46f3e5f0", "f0e5f3"), ("G8", "47", "474747"),
]


@pytest.mark.parametrize("kind,given,want", VECTORS)
def test_one_pixel(kind, given, want):
    raster, made = pixelformat.normalise(bytes.fromhex(given), 1, 1, kind)
    assert made == "RGB888" and raster.tobytes().hex() == want


@pytest.mark.parametrize("kind,given", [("RGB555", "479c"), ("RGB565", "479c"), ("BGR555", "23c8"), ("BGR565", "4788")])
def test_words_keep_their_bits(kind, given):
    r, g, b = map(int, pixelformat.normalise(bytes.fromhex(given), 1, 1, kind)[0][0, 0])
    first, last = (r, b) if kind.startswith("RGB") else (b, r)
    word = first >> 3 << 11 | g >> 2 << 5 | last >> 3 if kind.endswith("565") else first >> 3 << 10 | g >> 3 << 5 | last >> 3
    assert word == int(given, 16)


def test_packed_pixels():
    raster, made = pixelformat.normalise(bytes.fromhex("aa5580"), 17, 1, "G1")
    assert made == "G8" and raster[0].tolist() == [1, 0] * 4 + [0, 1] * 4 + [1]
    with pytest.raises(ValueError, match="2 bytes are too few"):
        pixelformat.normalise(bytes.fromhex("aa55"), 17, 1, "G1")
    assert pixelformat.normalise(b"\x1b", 4, 1, "PAL2")[0].tolist() == [[0, 1, 2, 3]]
    assert [pixelformat.raster_bytes(k, w, h) for k, w, h in (("G1", 9, 2), ("G2", 5, 3), ("G4", 3, 4), ("PAL1", 17, 1), ("RGB888", 2, 3))] == [4, 6, 8, 3, 18]


def test_raw_frames(spark):
    rows = [
        ("a", 1, 1, "PAL8", b"\0", bytes.fromhex("438997")), ("b", 1, 1, "PAL8", b"\1", bytes.fromhex("438997")), ("c", 2, 1, "G4", b"\x0f", None),
        ("d", 0, 1, "G8", b"", None), ("e", 1, 1, "what", b"x", None), (None, None, None, None, None, None), ("f", 1, 1, "PAL8", b"\0", None),
    ]
    df = spark.createDataFrame(rows, "source string, width int, height int, pixelformat string, pixels binary, palette binary")
    got = {r["source"]: r for r in pixelformat.raw_frames(df).collect()}
    assert bytes(got["a"]["pixels"]).hex() == "438997" and bytes(got["c"]["pixels"]).hex() == "000000ffffff"
    assert all(got[s]["message"] and got[s]["pixels"] is None for s in ("b", "d", "e", "f", None))
    assert pixelformat.raw_frames(df.where("false")).collect() == []


def bmp24(raster, top_down=False):
    height, width, _ = raster.shape
    lines = raster if top_down else raster[::-1]
    body = b"".join(r[:, ::-1].tobytes() + b"\0" * (-3 * width % 4) for r in lines)
    return b"BM" + struct.pack("<IIIIiiHHIIIIII", 54 + len(body), 0, 54, 40, width, -height if top_down else height, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def bmp8_runs(indices, table):
    height, width = indices.shape
    body = b"".join(b"".join(bytes((1, v)) for v in row.tolist()) + b"\0\0" for row in indices[::-1]) + b"\0\1"
    colours = b"".join(bytes((b, g, r, 0)) for r, g, b in table.tolist())
    offset = 54 + len(colours)
    return b"BM" + struct.pack("<IIIIiiHHIIIIII", offset + len(body), 0, offset, 40, width, height, 1, 8, 1, len(body), 0, 0, len(table), 0) + colours + body


def tga(raster, runs=False, top=False, footer=True):
    height, width, _ = raster.shape
    lines = (raster if top else raster[::-1])[:, :, ::-1].reshape(-1, 3)
    body = b"".join(b"\x80" + p.tobytes() for p in lines) if runs else lines.tobytes()
    head = struct.pack("<BBBHHBHHHHBB", 0, 0, 10 if runs else 2, 0, 0, 0, 0, 0, width, height, 24, 32 if top else 0)
    return head + body + (bytes(8) + b"TRUEVISION-XFILE.\0" if footer else b"")


def psd(raster, runs):
    height, width, _ = raster.shape
    planes = [raster[y, :, c].tobytes() for c in range(3) for y in range(height)]
    if runs:
        packed = [bytes((width - 1,)) + p for p in planes]
        body = b"\0\1" + b"".join(struct.pack(">H", len(p)) for p in packed) + b"".join(packed)
    else:
        body = b"\0\0" + b"".join(planes)
    return b"8BPS" + struct.pack(">H6xHIIHH", 1, 3, height, width, 8, 3) + bytes(12) + body


def pic(raster, mixed):
    height, width, _ = raster.shape
    head = b"\x53\x80\xf6\x34" + bytes(84) + b"PICT" + struct.pack(">HHfHH", width, height, 1.0, 3, 0)
    lines = b"".join((bytes((width - 1,)) if mixed else b"") + raster[y].tobytes() for y in range(height))
    return head + bytes((0, 8, 2 if mixed else 0, 0xE0)) + lines


WHOLE = {
    "a.bmp": bmp24(PICTURE), "b.bmp": bmp24(PICTURE, True), "c.tga": tga(PICTURE), "d.tga": tga(PICTURE, True, True), "e.tga": tga(PICTURE, footer=False),
    "f.psd": psd(PICTURE, False), "g.psd": psd(PICTURE, True), "h.pic": pic(PICTURE, False), "i.pic": pic(PICTURE, True), "j.png": png.write(PICTURE),
}


def test_every_format_in_one_call(spark, tmp_path):
    for name, data in WHOLE.items():
        (tmp_path / name).write_bytes(data)
    table = RNG.integers(0, 256, (4, 3)).astype(np.uint8)
    indices = RNG.integers(0, 4, (3, 5)).astype(np.uint8)
    (tmp_path / "k.bmp").write_bytes(bmp8_runs(indices, table))
    (tmp_path / "l.wbmp").write_bytes(b"\0\0\x09\x02" + bytes((0b10101010, 0b10000000, 0, 0)))
    (tmp_path / "m.hdr").write_bytes(b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y 1 +X 2\n" + bytes((128, 128, 128, 129, 0, 0, 0, 0)))
    (tmp_path / "n.tga").write_bytes(WHOLE["c.tga"][:40])
    (tmp_path / "o.bin").write_bytes(b"nothing known")
    image = spark._jvm.java.awt.image.BufferedImage(3, 2, 1)
    image.setRGB(1, 1, 0xFFFFFF)
    for kind in ("jpeg", "tiff"):
        file = spark._jvm.java.io.File(str(tmp_path / f"p.{kind}"))
        assert spark._jvm.javax.imageio.ImageIO.write(image, kind, file)
    got = {r["source"].rsplit("/", 1)[1]: r for r in loader.read_frames(spark, str(tmp_path)).collect()}
    for name in WHOLE:
        assert got[name]["message"] is None and loader.raster_of(got[name]).tolist() == PICTURE.tolist(), name
    assert loader.raster_of(got["k.bmp"]).tolist() == table[indices].tolist()
    assert loader.raster_of(got["l.wbmp"])[:, :, 0].tolist() == [[255, 0] * 4 + [255], [0] * 9]
    assert loader.raster_of(got["m.hdr"]).tolist() == [[[255] * 3, [0] * 3]]
    assert got["n.tga"]["message"] and got["o.bin"]["message"]
    assert (got["p.tiff"]["format"], got["p.jpeg"]["format"], got["p.jpeg"]["width"]) == ("tiff", "jpeg", 3)
    assert loader.raster_of(got["p.tiff"])[:, :, 0].tolist() == [[0, 0, 0], [0, 255, 0]]
    assert len(got) == len(WHOLE) + 7


def png_of(colour, depth, planes, chunks):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height, width = len(planes), len(planes[0]) // max(1, {0: 1, 2: 3, 4: 2}[colour] * depth // 8)
    rows = b"".join(b"\0" + bytes(p) for p in planes)
    return png.MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + b"".join(chunk(*c) for c in chunks) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_transparency_of_png():
    gray = png.read(png_of(0, 8, [[1, 2, 3]], []))
    assert gray["gray"] and gray["raster"].tolist() == [[1, 2, 3]]
    keyed = png.read(png_of(0, 8, [[1, 2, 3]], [(b"tRNS", b"\0\2"), (b"bKGD", b"\0\x50")]))
    assert not keyed["gray"] and keyed["raster"][0].tolist() == [[1] * 3, [0x50] * 3, [3] * 3]
    assert png.read(png_of(2, 8, [[1, 2, 3, 4, 5, 6]], [(b"tRNS", b"\0\4\0\5\0\6")]), (7, 8, 9))["raster"][0].tolist() == [[1, 2, 3], [7, 8, 9]]
    assert png.read(png_of(4, 8, [[100, 0, 100, 255]], [(b"bKGD", b"\0\x40")]))["raster"][0, 0].tolist() == [0x40 * 255 >> 8] * 3


def test_addresses(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(WHOLE["j.png"])
    asked = []

    class Handler(http.server.SimpleHTTPRequestHandler):
        def __init__(self, *args):
            super().__init__(*args, directory=str(tmp_path))

        def do_GET(self):
            asked.append(self.path)
            if self.path == "/moved":
                self.send_response(302)
                self.send_header("Location", "/a.png")
                self.end_headers()
            else:
                super().do_GET()

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    urls = spark.createDataFrame([(f"{base}/a.png",), (f"{base}/moved",), (f"{base}/none",), (None,)], "url string")
    got = {r["source"]: r for r in loader.read_urls(spark, urls).collect()}
    server.shutdown()
    assert all(loader.raster_of(got[f"{base}/{n}"]).tolist() == PICTURE.tolist() for n in ("a.png", "moved"))
    assert got[f"{base}/none"]["message"] and got[None]["message"]
    assert sorted(asked) == ["/a.png", "/a.png", "/moved", "/none"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, b"x" * 600), (2, None), (3, b"y" * 252), (4, b"")], "image_id long, data binary")
    out = writers.write_files(rows, str(tmp_path / "out"), "image_id", suffix=".six").collect()
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["1.six", "3.six", "4.six"] and (tmp_path / "out" / "1.six").read_bytes() == b"x" * 600
    assert [r["message"] is None for r in sorted(out, key=lambda r: r["bytes"])] .count(False) == 1
    wrapped = {r["image_id"]: r["data"] for r in writers.wrapped_streams(rows).collect()}
    assert bytes(wrapped[1]) == bandcodec.wrapped(b"x" * 600) and bytes(wrapped[3]) == bandcodec.wrapped(b"y" * 252) and wrapped[2] is None and bytes(wrapped[4]) == b""
    folder = tmp_path / "seen"
    folder.mkdir()

    def seen(data, folder=str(folder)):
        with open(f"{folder}/{len(data)}", "wb") as f:
            f.write(data)

    writers.for_each_stream(rows, seen)
    assert sorted(p.name for p in folder.iterdir()) == ["0", "252", "600"]
    frames = spark.createDataFrame([(1, 1, 1, b"\0", b"\1\2\3")], "image_id long, width int, height int, indices binary, palette binary")
    assert [writers.to_format(frames, k).first()["message"] for k in ("png", "bands", "jpeg")] == [None, None, "writing jpeg is not implemented"]


def test_a_cancelled_action_stops(spark):
    import time

    work = writers.Cancellable(spark)

    def slow(batches):
        for b in batches:
            time.sleep(60)
            yield b

    began = time.perf_counter()
    threading.Timer(2, work.cancel).start()
    with pytest.raises(writers.Cancelled):
        work.run(lambda: spark.range(4).mapInArrow(slow, "id long").collect())
    assert time.perf_counter() - began < 40
    assert spark.range(3).count() == 3


def test_ten_palettes():
    assert [len(builtin_palette(n)) for n in BUILTIN] == [2, 2, 16, 256, 16, 16, 2, 4, 16, 256]
    cube = builtin_palette("xterm256")
    assert cube[7] == (192, 192, 192) and cube[16 + 36 + 6 + 1] == (95, 95, 95) and cube[255] == (238, 238, 238) and builtin_palette("vt340mono")[0] == (33, 33, 33)
    assert builtin_palette("vt340color")[0] == (51, 51, 204) and builtin_palette("vt340color")[15] == (0, 0, 0)


@pytest.mark.parametrize("name", BUILTIN)
def test_encoding_with_builtin_palettes(name):
    indices, colours = decode(Encoder(builtin=name, diffusion="none").encode(PICTURE))
    palette = np.array(builtin_palette(name))
    away = ((PICTURE[:, :, None, :].astype(int) - palette) ** 2).sum(axis=3)
    if name.startswith("mono") or name == "gray1":  # black and white are told apart by brightness
        assert (indices == ((PICTURE.astype(int).sum(axis=2) >= 256) ^ (name == "monolight"))).all()
    else:
        assert (away[np.arange(5)[:, None], np.arange(7), indices] <= away.min(axis=2) + 3 * 16 * 255).all()


def test_further_options(tmp_path, spark):
    wide = RNG.integers(0, 256, (12, 40, 3)).astype(np.uint8)
    for kind in diffuse.MASKS:
        assert decode(Encoder(colours=8, diffusion=kind, quality="full").encode(wide))[0].shape == (12, 40)
    five = bandcodec.render(Encoder(high_colour=True, diffusion="none").encode(wide))
    assert len(np.unique(five.reshape(-1, 3), axis=0)) > 256 and np.abs(five.astype(int) - (wide & 0xF8)).max() <= 2
    few = np.array([[[0, 0, 248], [248, 0, 0], [0, 0, 248]]], np.uint8)
    indices, colours = decode(Encoder().encode(few))
    assert indices.tolist() == [[0, 1, 0]] and b"#2;" not in Encoder().encode(few)  # in the order of their first use, no others
    heavy = Encoder(mapfile=((255, 0, 0), (90, 100, 100)), diffusion="none", red_weight=100, quality="full").encode(np.array([[[200, 60, 60]]], np.uint8))
    assert decode(heavy)[0].tolist() == [[0]]
    assert Encoder(penetrate=True).encode(few).startswith(b"\x1bP\x1bPq") and Encoder.invoke(3) == b"\x1b[3*z"
    for bad in ({"high_colour": True, "monochrome": True}, {"penetrate": True, "style": Style(eight_bit=True)}, {"red_weight": 0}):
        with pytest.raises(ValueError):
            Encoder(**bad)
    (tmp_path / "map.png").write_bytes(png.write(few))
    assert sorted(palette_from_file(spark, str(tmp_path / "map.png"))) == [(0, 0, 248), (248, 0, 0)]
    (row,) = Encoder(loop="disable").encode_files(spark, str(tmp_path / "map.png")).collect()
    assert row["data"] is not None and row["message"] is None
    nulls = spark.createDataFrame([("s", 0, 0, 0, None, 1, "RGB888", None, None, None)], "source string, loop_no int, frame_no int, delay int, width int, height int, pixelformat string, pixels binary, palette binary, message string")
    assert Encoder().encode_frames(nulls).first()["message"]


@pytest.mark.parametrize("kernel", [*diffuse.KERNELS, *diffuse.MASKS])
@pytest.mark.parametrize("cached", [True, False])
def test_one_picture_as_in_a_stack(kernel, cached):
    for size in ((9, 11), (1, 5), (5, 1), (2, 3)):
        pixels = RNG.integers(0, 256, (2, size[0] * size[1], 3))
        for own in (RNG.integers(0, 256, (5, 3)), np.array([[0, 0, 0], [255, 255, 255]]), np.array([[255, 255, 255], [0, 0, 0]])):
            sizes = np.array([len(own)] * 2)
            both = diffuse.diffuse(pixels, np.stack([own, own]), sizes, *size, kernel, cached, 2)
            for k in range(2):
                assert (diffuse.diffuse(pixels[k : k + 1], own[None], sizes[:1], *size, kernel, cached, 2)[0] == both[k]).all()


def test_names_of_colours_from_a_file(spark, tmp_path):
    from pyspark.sql import functions as F

    from pixloom.functions.color import parse_colour
    from pixloom.sources.names import read_names

    (tmp_path / "rgb.txt").write_text("! comment\n255 250 250\t\tsnow\n248 248 255   ghost white\n\n# other\n1 2 x bad\n  0   0 128 Navy\n")
    names = read_names(spark, str(tmp_path / "rgb.txt"))
    assert names == {"snow": (255, 250, 250), "ghost white": (248, 248, 255), "navy": (0, 0, 128)}
    rows = spark.createDataFrame([("Snow",), ("GHOST WHITE",), ("none",)], "s string").select(parse_colour(F.col("s"), names).alias("c")).collect()
    assert [r["c"] and tuple(r["c"]) for r in rows] == [(255, 250, 250), (248, 248, 255), None]


def test_sizes_are_clamped():
    assert geometry.target_size(10, 20, "150%", None) == (15, 30) and geometry.target_size(10, 20, 10**9, 5) == (10**6, 5) and geometry.target_size(3, 2, None, "1px") == (2, 1)
    with pytest.raises(ValueError):
        geometry.target_size(10, 20, "150%x")


def test_masks_agree_with_expressions(spark):
    from pixloom.functions.color import mask_additive, mask_xor
    from pyspark.sql import functions as F

    rows = spark.range(64).select((F.col("id") % 8).alias("x"), F.expr("id div 8").alias("y"))
    for kind, expression in (("additive", mask_additive), ("xor", mask_xor)):
        want = diffuse.mask(kind, 8, 8)
        for r in rows.select("x", "y", *[expression(F.col("x"), F.col("y"), c).alias(f"c{c}") for c in range(3)]).collect():
            assert [r[f"c{c}"] for c in range(3)] == want[r["y"], r["x"]].tolist()
    assert highcolor.MASKS == diffuse.MASKS
