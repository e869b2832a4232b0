"""Shared plumbing of the text operators."""

from __future__ import annotations

import ctypes
import functools
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Rows handed to a Python function at a time; bounds memory when texts are long.
BATCH_ROWS = 1000
#: Bytes that Spark hands over at a time, one row at least.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; other letters stay, whatever the locale."""
    return F.translate(col, UPPER, LOWER)


def utf8(col: str = "text") -> Column:
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Re-slice Arrow batches so that Python never unpacks more than ``rows`` texts at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def release_memory() -> None:
    """Give freed memory back to the system: idle Python workers live on, and what they hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
    if trim is not None:
        trim(0)


def lean(function: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow whose task leaves no freed memory behind."""

    @functools.wraps(function)
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            release_memory()

    return run


#: Rows that a task holds to compress them together.
PIECE_BYTES = 16 << 20


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, piece): the rows of each value of the column block, compressed together as far as a task meets them."""

    def flushed() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        table = table.take(pa.compute.sort_indices(table["block"]))
        block = table["block"].to_numpy()
        cuts = [0, *((block[1:] != block[:-1]).nonzero()[0] + 1).tolist(), len(block)]
        out = []
        for start, stop in zip(cuts, cuts[1:]):
            sink = pa.BufferOutputStream()
            part = table.slice(start, stop - start).drop_columns("block").combine_chunks()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(part)
            out.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]], pa.int64()), pa.array(out, pa.binary())], names=["block", "piece"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) > PIECE_BYTES:
            yield flushed()
            held = []
    if held:
        yield flushed()


def unpacked_piece(piece: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(piece.as_buffer()).read_all()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; where it is unset, a folder of this machine if all of Spark runs here."""
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return shared or sc.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder wherever Spark's paths reach."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_batches(df: DataFrame) -> DataFrame:
    """Have Spark cut Arrow batches by bytes too, so that long texts don't pile up in one batch.

    The option belongs to the session and is read when a job runs, so it stays
    set; a smaller value of the session's own is kept.
    """
    conf = df.sparkSession.conf
    known = conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")
    if not known.isdigit() or int(known) > BATCH_BYTES:  # other units are larger
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df
