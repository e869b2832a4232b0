"""Six-row bands: bit planes, intervals with small gaps merged, run lengths, and the stream's texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixloom.functions.color import rgb_to_hls, to_percent

GAP = 10  # empty columns that end an interval


def planes(indexed: DataFrame, transparent: int | None = None) -> DataFrame:
    """image_id, band, idx, x, bits: the rows of a band that a colour takes in a column, lowest bit on top."""
    drawn = indexed if transparent is None else indexed.where(F.col("idx") != transparent)
    return drawn.groupBy("image_id", F.expr("y DIV 6").alias("band"), "idx", "x").agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(y % 6 AS INT))")).alias("bits")
    )


def intervals(bits: DataFrame) -> DataFrame:
    """image_id, band, idx, sx, mx (exclusive): islands of one colour; fewer than GAP empty columns are bridged."""
    row = Window.partitionBy("image_id", "band", "idx").orderBy("x")
    starts = F.coalesce((F.col("x") - F.lag("x").over(row) > GAP).cast("long"), F.lit(0))
    marked = bits.withColumn("__start", starts).withColumn("__island", F.sum("__start").over(row))
    return marked.groupBy("image_id", "band", "idx", "__island").agg(F.min("x").alias("sx"), (F.max("x") + 1).alias("mx")).drop("__island")


def drawing_order(nodes: DataFrame) -> DataFrame:
    """The place of each interval in its band: by start, then the longer, then the lower colour."""
    order = Window.partitionBy("image_id", "band").orderBy("sx", F.col("mx").desc(), "idx")
    return nodes.withColumn("place", F.row_number().over(order).cast("long"))


def runs(indexed: DataFrame) -> DataFrame:
    """image_id, y, start, idx, n: runs of equal indices in a row."""
    row = Window.partitionBy("image_id", "y").orderBy("x")
    changed = F.coalesce((F.col("idx") != F.lag("idx").over(row)).cast("long"), F.lit(0))
    marked = indexed.withColumn("__new", changed).withColumn("__run", F.sum("__new").over(row))
    return marked.groupBy("image_id", "y", "__run").agg(
        F.min("x").alias("start"), F.min("idx").alias("idx"), F.count("*").alias("n")
    ).drop("__run")


def run_text(char: Column, n: Column, limit_255: bool = False) -> Column:
    """A run as text: ``!n`` and the character when longer than three; optionally in pieces of 255."""
    rest = n % 255 if limit_255 else n
    rest = F.when((n > 0) & (rest == 0), 255).otherwise(rest) if limit_255 else rest
    head = F.repeat(F.concat(F.lit("!255"), char), ((n - rest) / 255).cast("int")) if limit_255 else F.lit("")
    tail = F.when(rest > 3, F.concat(F.lit("!"), rest.cast("string"), char)).otherwise(F.repeat(char, rest.cast("int")))
    return F.concat(head, tail)


def header(width: Column, height: Column, eight_bit: bool = False) -> Column:
    start = "\x90" if eight_bit else "\x1bP"
    return F.concat(F.lit(f'{start}q"1;1;'), width.cast("string"), F.lit(";"), height.cast("string"))


def footer(eight_bit: bool = False) -> str:
    return "\x9c" if eight_bit else "\x1b\\"


def colour_text(idx: Column, r: Column, g: Column, b: Column, hls: bool = False) -> Column:
    values = rgb_to_hls(r, g, b) if hls else tuple(to_percent(c) for c in (r, g, b))
    return F.concat(F.lit("#"), F.concat_ws(";", idx.cast("string"), F.lit("1" if hls else "2"), *[v.cast("string") for v in values]))


def palette_text(palette: DataFrame, hls: bool = False, transparent: int | None = None) -> DataFrame:
    """image_id, palette_text: the colour definitions in index order."""
    shown = palette if transparent is None else palette.where(F.col("idx") != transparent)
    text = colour_text(F.col("idx"), F.col("r"), F.col("g"), F.col("b"), hls)
    return shown.groupBy("image_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", text.alias("t")))), lambda e: e["t"]), "").alias("palette_text")
    )


def macro_text(data: Column, number: int) -> Column:
    """A stream as the hexadecimal body of a terminal macro."""
    return F.concat(F.lit(f"\x1bP{number};0;1!z"), F.lower(F.hex(data)), F.lit("\x1b\\"))
