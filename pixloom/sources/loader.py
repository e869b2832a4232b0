"""Files to frames: one row of ``binaryFile`` gives one row for each frame.

Formats are told by their first bytes.  JPEG and TIFF go through the JVM's image
reader, ``spark.read.format("image")``, the others through numpy, each file in
the task that holds it.  A file that cannot be read keeps a row with a message;
an empty file gives no row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixloom.operators.bandcodec import decode, render
from pixloom.sources import bitmaps, gif, png, pnm
from pixloom.sources.sniff import format_of

SCHEMA = (
    "source string, format string, loop_no int, frame_no int, delay int, multiframe boolean, width int, height int, "
    "pixelformat string, pixels binary, palette binary, message string"
)
_KINDS = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.string()]
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def frames_of(kind: str, data: bytes, background=None, static: bool = False, loops: int = 1, force: bool = False,
              reqcolours: int = 256) -> Iterator[tuple]:
    """(loop_no, frame_no, delay, multiframe, width, height, pixelformat, pixels, palette) of a file.

    An animation is repeated ``loops`` times at most, and as often as it says if
    that is less and not ``force``; ``static`` stops after the first frame.  A
    stream of more than ``reqcolours`` colours is painted, others keep their palette.
    """
    if kind == "gif":
        every = list(gif.frames(data, background))
        said = next((f["loops"] for f in every if f["loops"] is not None), None)
        rounds = 1 if static or len(every) < 2 else loops if force or said == 0 else 1 if said is None else min(loops, said)
        for loop in range(rounds):
            for f in every[: 1 if static else None]:
                yield loop, f["frame_no"], f["delay"], len(every) > 1, f["width"], f["height"], "RGB888", f["raster"].tobytes(), None
    elif kind == "pnm":
        raster, width, height = pnm.read(data)
        yield 0, 0, 0, False, width, height, "RGB888", raster.tobytes(), None
    elif kind == "png":
        p = png.read(data, background)
        indexed = p["palette"] is not None
        yield 0, 0, 0, False, p["width"], p["height"], "PAL8" if indexed else "G8" if p["gray"] else "RGB888", p["raster"].tobytes(), p["palette"].tobytes() if indexed else None
    elif kind in bitmaps.READERS:
        raster = bitmaps.READERS[kind](data)
        yield 0, 0, 0, False, raster.shape[1], raster.shape[0], "RGB888", raster.tobytes(), None
    elif kind == "bands":
        raster, palette = decode(data)
        if len(palette) > reqcolours:
            painted = render(data)
            yield 0, 0, 0, False, painted.shape[1], painted.shape[0], "RGB888", painted.tobytes(), None
            return
        yield 0, 0, 0, False, raster.shape[1], raster.shape[0], "PAL8", raster.tobytes(), palette.tobytes()
    else:
        raise ValueError(f"no reader for {kind or 'unknown bytes'}")


def decode_files(files: DataFrame, background: tuple[int, int, int] | None = None, static: bool = False, loops: int = 1, force: bool = False,
                 reqcolours: int = 256) -> DataFrame:
    """Frames of a (batch or streaming) ``binaryFile`` table; rows that come with a message keep it and are not decoded."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, kind, data, lost in zip(*(batch.column(i) for i in range(4))):
                path, kind, data, lost = path.as_py(), kind.as_py(), data.as_py(), lost.as_py()
                if lost is None and data in (b"", b"\n"):
                    continue
                if lost is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((path, kind, 0, 0, 0, False, None, None, None, None, None, lost), _KINDS)], names=_NAMES)
                    continue
                try:
                    rows = [(path, kind, *f, None) for f in frames_of(kind, data, background, static, loops, force, reqcolours)]
                except (ValueError, IndexError, KeyError, OSError) as e:
                    rows = [(path, kind, 0, 0, 0, False, None, None, None, None, None, str(e) or type(e).__name__)]
                except Exception as e:  # zlib and struct have errors of their own
                    rows = [(path, kind, 0, 0, 0, False, None, None, None, None, None, f"damaged file: {e}")]
                for row in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _KINDS)], names=_NAMES)

    lost = F.col("message") if "message" in files.columns else F.lit(None).cast("string")
    return files.select("path", format_of(F.col("content")).alias("kind"), "content", lost.alias("message")).mapInArrow(run, SCHEMA)


#: Formats that the JVM reads.
BY_JVM = ("jpeg", "tiff")
#: Rounds of an animation by loop control: as often as it says, once, or without end; a table needs a bound.
LOOPS = ("auto", "disable", "force")


def read_frames(spark: SparkSession, path: str, background: tuple[int, int, int] | None = None, static: bool = False,
                loops: int = 1, loop: str = "auto", reqcolours: int = 256) -> DataFrame:
    """Frames of all files below a path, whatever their formats.

    ``loop`` is "auto" (an animation is repeated as often as it says, ``loops``
    times at most, which also bounds endless ones), "disable" (once) or "force"
    (``loops`` times, whatever it says).
    """
    if loop not in LOOPS:
        raise ValueError(f"unknown loop control {loop!r}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = format_of(F.col("content"))
    own = decode_files(files.where(~F.coalesce(kind.isin(*BY_JVM), F.lit(False))), background, static, 1 if loop == "disable" else loops, loop == "force", reqcolours)
    place = lambda c: F.regexp_replace(c, "^file:/+", "/")
    wanted = files.where(kind.isin(*BY_JVM)).select(place(F.col("path")).alias("__place"), kind.alias("__kind"))
    other = read_images(spark, path).withColumn("__place", place(F.col("source"))).join(wanted, "__place")
    return own.unionAll(other.withColumn("format", F.col("__kind")).select(*own.columns))


def read_urls(spark: SparkSession, urls: DataFrame, url_col: str = "url", timeout: float = 30.0, insecure: bool = False, **options) -> DataFrame:
    """Frames of the files that a column of addresses names, fetched by the tasks; redirects are followed.

    Addresses are dealt evenly and fetched once; one that cannot be fetched keeps
    a row with a message.  JPEG and TIFF are for ``read_frames``.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ssl
        import urllib.request

        trust = ssl._create_unverified_context() if insecure else None
        for batch in batches:
            for url in batch.column(0).to_pylist():
                content, message = None, None
                try:
                    with urllib.request.urlopen(url or "", timeout=timeout, context=trust if (url or "").startswith("https") else None) as answer:
                        content = answer.read()
                except (OSError, ValueError) as e:
                    message = f"cannot be fetched: {e}"
                yield pa.RecordBatch.from_arrays([pa.array([url], pa.string()), pa.array([content], pa.binary()), pa.array([message], pa.string())], names=["path", "content", "message"])

    got = urls.select(F.col(url_col).cast("string")).mapInArrow(run, "path string, content binary, message string")
    return decode_files(got, **options)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """JPEG, BMP, TIFF (and other) files by the JVM's image reader, as frames; its pixels are blue first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for origin, height, width, planes, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if width is None or width < 0 or planes not in (1, 3, 4):
                    row = (origin, "image", 0, 0, 0, False, None, None, None, None, None, "not an image that can be read")
                else:
                    raster = np.frombuffer(data, np.uint8).reshape(height, width, planes)
                    rgb = np.repeat(raster, 3, axis=2) if planes == 1 else raster[:, :, 2::-1]
                    row = (origin, "image", 0, 0, 0, False, width, height, "RGB888", rgb.tobytes(), None, None)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _KINDS)], names=_NAMES)

    files = spark.read.format("image").option("dropInvalid", "false").load(path)
    return files.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(run, SCHEMA)


def raster_of(row) -> np.ndarray:
    """RGB raster of a frame row."""
    flat = np.frombuffer(row["pixels"], np.uint8)
    if row["pixelformat"] == "PAL8":
        return np.frombuffer(row["palette"], np.uint8).reshape(-1, 3)[flat].reshape(row["height"], row["width"], 3)
    if row["pixelformat"] == "G8":
        return np.repeat(flat.reshape(row["height"], row["width"], 1), 3, axis=2)
    return flat.reshape(row["height"], row["width"], 3)
