"""Frames to files: PNG or ready streams, written by the tasks that hold them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixloom.operators import bandcodec
from pixloom.sources import png


def to_png(indexed: DataFrame) -> DataFrame:
    """image_id and png of frames with indices and palette."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                colours = np.zeros((256, 3), np.uint8)
                own = np.frombuffer(r["palette"], np.uint8).reshape(-1, 3)
                colours[: len(own)] = own
                raster = colours[np.frombuffer(r["indices"], np.uint8)].reshape(r["height"], r["width"], 3)
                out.append(png.write(raster))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["image_id", "png"])

    return indexed.select("image_id", "width", "height", "indices", "palette").mapInArrow(run, "image_id long, png binary")


SUPPORTED = ("png", "bands")


def to_format(indexed: DataFrame, kind: str) -> DataFrame:
    """image_id, data and message: frames with indices and palette in a format; those that cannot be written say so."""
    if kind == "png":
        return to_png(indexed).select("image_id", F.col("png").alias("data"), F.lit(None).cast("string").alias("message"))
    if kind == "bands":
        return bandcodec.encode_frames(indexed)
    return indexed.select("image_id", F.lit(None).cast("binary").alias("data"), F.lit(f"writing {kind} is not implemented").alias("message"))


def wrapped_streams(streams: DataFrame, data_col: str = "data", size: int = 256) -> DataFrame:
    """All columns, the streams in device control strings of at most ``size`` bytes for a terminal multiplexer; native."""
    room = size - 4
    data = F.col(data_col)
    parts = F.transform(
        F.sequence(F.lit(0), F.call_function("div", F.octet_length(data) - 1, F.lit(room)).cast("int")),
        lambda k: F.concat(F.lit("1B50"), F.hex(F.substring(data, k * room + 1, F.lit(room))), F.lit("1B5C")),
    )
    return streams.withColumn(data_col, F.when(F.octet_length(data) > 0, F.unhex(F.array_join(parts, ""))).otherwise(data))


def write_files(rows: DataFrame, folder: str, name_col: str, data_col: str = "data", suffix: str = "") -> DataFrame:
    """One file for each row with data, written by the task that holds it; returns file, bytes and message when run.

    ``folder`` is a path that all executors share, or an address that pyarrow's
    filesystems know.  A file is written beside its place and then moved, so a
    task that runs again leaves whole files.  Names must be unique; characters
    that paths give a meaning become underscores.
    """
    names, kinds = ["file", "bytes", "message"], [pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        system.create_dir(base, recursive=True)
        for batch in batches:
            out = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py()
                if name is None or data is None:
                    out.append((None, 0, "no name or no data"))
                    continue
                file = f"{base}/{re.sub(r'[^A-Za-z0-9._-]', '_', name)}{suffix}"
                beside = f"{file}.{uuid.uuid4().hex}"
                with system.open_output_stream(beside) as sink:
                    sink.write(data)
                system.move(beside, file)
                out.append((file, len(data), None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return rows.select(F.col(name_col).cast("string"), F.col(data_col)).mapInArrow(run, "file string, bytes long, message string")


def for_each_stream(rows: DataFrame, callback: Callable[[bytes], object], data_col: str = "data") -> None:
    """Hand each stream to a function, in the tasks that hold them; a row that runs again is handed over again."""
    rows.select(data_col).where(F.col(data_col).isNotNull()).foreach(lambda r: callback(bytes(r[0])))


class Cancellable:
    """Runs actions as one group of jobs that another thread can stop; a stopped action raises ``Cancelled``."""

    def __init__(self, spark: SparkSession):
        import uuid

        self.spark, self.group, self.stopped = spark, f"cancellable-{uuid.uuid4().hex}", False

    def run(self, action: Callable[[], object]) -> object:
        sc = self.spark.sparkContext
        if self.stopped:
            raise Cancelled(self.group)
        sc.setJobGroup(self.group, "can be stopped", interruptOnCancel=True)
        try:
            return action()
        except Exception as e:
            if self.stopped:
                raise Cancelled(self.group) from e
            raise
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)

    def cancel(self) -> None:
        self.stopped = True
        self.spark.sparkContext.cancelJobGroup(self.group)


class Cancelled(RuntimeError):
    pass
