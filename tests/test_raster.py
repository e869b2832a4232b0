"""Order-dependent operators against plain models, round trips and fixed streams."""

import struct
import zlib

import numpy as np
import pytest

from pixloom.operators import bandcodec, diffuse, highcolor, palette
from pixloom.operators.bandcodec import BadStream, Style, decode, encode, render
from pixloom.sources import gif, png, pnm

RNG = np.random.default_rng(3)


def model(pixels, pal, width, height, kernel):
    """One picture, pixel by pixel, in plain Python."""
    data = [[int(v) for v in p] for p in pixels]
    out = []
    for pos in range(width * height):
        here = list(data[pos])
        best = min(range(len(pal)), key=lambda i: (sum((a - int(b)) ** 2 for a, b in zip(here, pal[i])), i))
        out.append(best)
        y, x = divmod(pos, width)
        if diffuse.spreads(kernel, x, y, width, height):
            for down, right, num, den in diffuse.KERNELS[kernel]:
                to = pos + down * width + right
                for c in range(3):
                    error = here[c] - int(pal[best][c])
                    data[to][c] = min(255, max(0, data[to][c] + int(error * num / den)))
    return out


@pytest.mark.parametrize("kernel", list(diffuse.KERNELS))
def test_diffusion_equals_the_model(kernel):
    width, height, n = 7, 6, 5
    pixels = RNG.integers(0, 256, (n, width * height, 3))
    pals = RNG.integers(0, 256, (n, 6, 3))
    sizes = np.array([6, 6, 4, 6, 3])
    got = diffuse.diffuse(pixels, pals, sizes, width, height, kernel)
    for i in range(n):
        assert got[i].tolist() == model(pixels[i], pals[i][: sizes[i]], width, height, kernel)


def test_narrow_pictures_are_not_diffused():
    pixels = RNG.integers(0, 256, (1, 5, 3))
    pal = RNG.integers(0, 256, (1, 4, 3))
    plain = diffuse.diffuse(pixels, pal, np.array([4]), 1, 5, "none")
    assert (diffuse.diffuse(pixels, pal, np.array([4]), 1, 5, "burkes") == plain).all()


def test_two_colours_go_by_brightness():
    pixels = np.array([[[85, 85, 85], [86, 85, 85]]])
    dark = np.array([[[0, 0, 0], [255, 255, 255]]])
    assert diffuse.diffuse(pixels, dark, np.array([2]), 2, 1, "none").tolist() == [[0, 1]]
    assert diffuse.diffuse(pixels, dark[:, ::-1], np.array([2]), 2, 1, "none").tolist() == [[1, 0]]


def test_median_cut():
    colours = np.array([[0, 0, 0], [8, 0, 0], [248, 0, 0], [248, 8, 0]])
    counts = np.array([10, 1, 5, 5])
    assert palette.cut(colours, counts, 4).tolist() == colours.tolist()
    assert palette.cut(colours, counts, 2).tolist() == [[128, 4, 0], [0, 0, 0]]
    assert palette.cut(colours, counts, 2, rep="pixel_mean").tolist() == [[226, 3, 0], [0, 0, 0]]
    assert len(palette.cut(RNG.integers(0, 32, (500, 3)) * 8, RNG.integers(1, 9, 500), 16)) == 16


@pytest.mark.parametrize("style", [Style(), Style(eight_bit=True), Style(limit_255=True), Style(fill=True), Style(hls=True)])
@pytest.mark.parametrize("shape", [(1, 1), (6, 6), (5, 9), (13, 300), (20, 700)])
def test_streams_round_trip(style, shape):
    pal = RNG.integers(0, 101, (9, 3)) * 255 // 100
    indices = RNG.integers(0, 9, shape) if shape != (20, 700) else np.repeat(RNG.integers(0, 9, (20, 1)), 700, axis=1)
    back, colours = decode(encode(indices, pal, style))
    assert back.shape == shape and (back == indices).all()
    if not style.hls:
        assert np.abs(colours[: int(indices.max()) + 1].astype(int) - pal[: int(indices.max()) + 1]).max() <= 3


def test_transparent_pixels_stay_out():
    indices = np.array([[0, 1, 2]])
    back, _ = decode(encode(indices, np.zeros((3, 3), int), Style(transparent=1)))
    assert back.tolist() == [[0, 255, 2]]


def test_fixed_stream():
    six, _ = decode(b'\x1bPq"1;1;1;1!6~\x1b\\')
    assert six.shape == (6, 6) and (six == 15).all()
    twice = np.zeros((12, 12), int)
    assert encode(twice, np.array([[204, 204, 204]])).endswith(b"#0!12~-!12~\x1b\\")


@pytest.mark.parametrize("stream", [b"", b"plain text", b"\x1bPq!70000~", b"\x1bPq#99999999999999~", b"\x1bPq" + b"-" * 166_667 + b"A"])
def test_bad_streams(stream):
    with pytest.raises(BadStream):
        decode(stream)


def test_streams_keep_colours_that_are_defined_but_not_drawn(spark):
    pal = np.array([[51 * i, 0, 255 - 51 * i] for i in range(5)])
    data = {1: encode(np.array([[0, 1]]), pal), 2: encode(np.array([[4, 0]]), pal), 3: b"\x1bPq#200;2;100;0;0#1~\x1b\\", 4: b"\x1bPq#7~\x1b\\", 5: b"none"}
    streams = spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "image_id long, data binary")
    rows = {r["image_id"]: r for r in bandcodec.decode_streams(streams).collect()}
    whole = pal.astype(np.uint8).tobytes()
    assert bytes(rows[1]["registers"]) == bytes(rows[2]["registers"]) == whole
    assert rows[1]["ncolors"] == 3 and bytes(rows[1]["palette"]) == whole[:9] and bytes(rows[2]["palette"]) == whole  # counted by what is drawn
    assert bytes(rows[3]["registers"])[-3:] == b"\xff\0\0" and len(rows[3]["registers"]) == 201 * 3 and rows[3]["ncolors"] == 3
    assert rows[4]["registers"] == rows[4]["palette"] and rows[4]["ncolors"] == 8  # drawn, not defined
    assert rows[5]["registers"] is None and rows[5]["message"]


def test_decoded_streams_of_few_colours_equal_sql(spark, tmp_path):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    import __spark_entry__ as entry

    own = np.random.default_rng(17)
    low = [-1.0, -0.9, -0.5, 0.0, 0.4, 0.9, 1.0]
    vectors = [np.full(64, v) for v in low] + [own.uniform(v, v + 0.03, 64) for v in low[:-1]] + [own.uniform(-0.5, 0.5, 64)]
    table = pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array([v.tolist() for v in vectors], pa.list_(pa.float32()))})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = con.execute(f"SELECT image_id, width, height, indices, colours, message FROM ({entry.oracle_sql()['c10_decode_stream']}) ORDER BY image_id").fetchall()
    got = entry.queries()["c10_decode_stream"](spark, str(tmp_path)).select("image_id", "width", "height", "indices", "colours", "message").collect()
    assert len(want) == len(vectors) and any("07" not in [w[3][i : i + 2] for i in range(0, 128, 2)] for w in want)
    assert sorted(map(tuple, got)) == want


def test_wrapping():
    parts = bandcodec.wrapped(b"x" * 600)
    assert parts.count(b"\x1bP") == 3 and parts.replace(b"\x1bP", b"").replace(b"\x1b\\", b"") == b"x" * 600


def test_png_round_trip_and_palettes():
    raster = RNG.integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert (png.read(png.write(raster))["raster"] == raster).all()

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"\0\xb0" + b"\0\x40"  # 2-bit indices 2 3 0 and 1 0 0
    data = png.MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 2, 3, 0, 0, 0)) + chunk(b"PLTE", bytes(range(12))) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    got = png.read(data)
    assert got["raster"].tolist() == [[2, 3, 0], [1, 0, 0]] and got["palette"].tolist()[3] == [9, 10, 11]
    with pytest.raises(ValueError):
        png.read(data[:40] + b"\0" + data[41:])


@pytest.mark.parametrize("data, want", [
    (b"P1\n# c\n3 1\n1 0 1\n", [0, 255, 0]),
    (b"P2 3 1 4\n0 2 4", [0, 127, 255]),
    (b"P4\n3 1\n\xa0", [0, 255, 0]),
    (b"P5 3 1 255\n\x00\x80\xff", [0, 128, 255]),
])
def test_gray_maps(data, want):
    raster, width, height = pnm.read(data)
    assert (width, height) == (3, 1) and raster[0, :, 0].tolist() == want


def test_colour_map():
    assert pnm.read(b"P6 2 1 255\n\1\2\3\4\5\6")[0].tolist() == [[[1, 2, 3], [4, 5, 6]]]
    assert pnm.read(b"P3 1 1 255\n7 8 9")[0].tolist() == [[[7, 8, 9]]]


def gif_of(frames, loops=2):
    """Frames of (left, top, rows of indices, disposal, transparent) on a 4 x 4 screen, LZW with clears."""
    table = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    out = b"GIF89a" + struct.pack("<HHBBB", 4, 4, 0x81, 0, 0) + table
    out += b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", loops) + b"\0"
    for left, top, rows, disposal, clear in frames:
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (clear >= 0), 7, 0, max(clear, 0)]) + b"\0"
        out += b"\x2c" + struct.pack("<HHHHB", left, top, len(rows[0]), len(rows), 0)
        codes = [c for v in sum(rows, []) for c in (4, v)] + [5]
        bits = sum(c << 3 * i for i, c in enumerate(codes))
        body = bits.to_bytes((3 * len(codes) + 7) // 8, "little")
        out += b"\x02" + bytes([len(body)]) + body + b"\0"
    return out + b"\x3b"


def test_gif_disposal():
    got = list(gif.frames(gif_of([(0, 0, [[1] * 4] * 4, 1, -1), (1, 1, [[2, 2], [2, 0]], 3, 0), (0, 0, [[3]], 2, -1), (3, 3, [[2]], 0, -1)])))
    red, green, blue, black = [255, 0, 0], [0, 255, 0], [0, 0, 255], [0, 0, 0]
    assert [f["frame_no"] for f in got] == [0, 1, 2, 3] and got[0]["delay"] == 7 and got[0]["loops"] == 2
    assert got[1]["raster"][1, 1].tolist() == green and got[1]["raster"][2, 2].tolist() == red
    assert got[2]["raster"][1, 1].tolist() == red and got[2]["raster"][0, 0].tolist() == blue
    assert got[3]["raster"][0, 0].tolist() == black and got[3]["raster"][3, 3].tolist() == green


def test_files_to_frames(spark, tmp_path):
    from pixloom.sources.loader import read_frames

    (tmp_path / "a.gif").write_bytes(gif_of([(0, 0, [[1] * 4] * 4, 1, -1), (1, 1, [[2]], 1, -1)]))
    (tmp_path / "b.ppm").write_bytes(b"P6 2 1 255\n\1\2\3\4\5\6")
    (tmp_path / "c.six").write_bytes(encode(np.array([[0, 1]]), np.array([[0, 0, 0], [255, 255, 255]])))
    (tmp_path / "d.png").write_bytes(png.write(np.zeros((2, 2, 3), np.uint8)))
    (tmp_path / "e.txt").write_bytes(b"")
    (tmp_path / "f.bin").write_bytes(b"GIF89a")
    rows = read_frames(spark, str(tmp_path), loops=2).collect()
    by = {}
    for r in rows:
        by.setdefault(r["source"].rsplit("/", 1)[1], []).append(r)
    assert [(r["loop_no"], r["frame_no"]) for r in by["a.gif"]] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert by["b.ppm"][0]["width"] == 2 and by["c.six"][0]["pixelformat"] == "PAL8" and by["d.png"][0]["height"] == 2
    assert "e.txt" not in by and by["f.bin"][0]["message"]


def test_watched_folder(spark, tmp_path):
    from pixloom.streaming.watch import watch_frames

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.gif").write_bytes(gif_of([(0, 0, [[1] * 4] * 4, 1, -1), (1, 1, [[2]], 1, -1)]))
    q = watch_frames(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("frames_seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert spark.table("frames_seen").count() == 2


def test_images_of_the_jvm_reader(spark, tmp_path):
    from pixloom.sources.loader import read_images

    head = struct.pack("<IIIIiiHHIIiiII", 54 + 8, 0, 54, 40, 2, 1, 1, 24, 0, 8, 0, 0, 0, 0)
    (tmp_path / "a.bmp").write_bytes(b"BM" + head + bytes([1, 2, 3, 4, 5, 6, 0, 0]))
    (tmp_path / "b.bmp").write_bytes(b"nothing")
    rows = {r["source"].rsplit("/", 1)[1]: r for r in read_images(spark, str(tmp_path)).collect()}
    assert bytes(rows["a.bmp"]["pixels"]) == bytes([3, 2, 1, 6, 5, 4]) and rows["b.bmp"]["message"]


def plain_dither15(raster, kernel):
    plus, low_rows, low_columns, shares = highcolor.KERNELS[kernel]
    height, width, _ = raster.shape
    data = [[int(v) for v in p] for p in raster.reshape(-1, 3)]
    for pos in range(width * height):
        y, x = divmod(pos, width)
        if x < width - low_columns and y < height - low_rows:
            for c in range(3):
                lost = data[pos][c] % 8 + plus
                for down, right, num, den in shares:
                    to = pos + down * width + right
                    data[to][c] = min(255, data[to][c] + lost * num // den)
    return (np.array(data) // 8 * 8).reshape(raster.shape)


@pytest.mark.parametrize("kernel", list(highcolor.KERNELS))
def test_dither15_equals_the_model(kernel):
    rasters = RNG.integers(0, 256, (3, 6, 7, 3))
    got = highcolor.dither15(rasters, kernel)
    for i in range(3):
        assert (got[i] == plain_dither15(rasters[i], kernel)).all()


@pytest.mark.parametrize("kernel", ["none", "stucki", *highcolor.MASKS])
def test_high_colour_streams(kernel):
    raster = RNG.integers(0, 256, (14, 90, 3))
    want = highcolor.dither15(raster[None], kernel)[0]
    shown = render(highcolor.encode_high(raster, kernel))
    assert shown.shape == raster.shape and np.abs(shown.astype(int) - want).max() <= 2  # colours travel as whole per cents
    assert len(np.unique(want.reshape(-1, 3), axis=0)) > 256
