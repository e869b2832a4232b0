"""Media columns: find out what the bytes of a column are, and what is inside them.

One Aho-Corasick pass over a value locates the magic bytes of every known
format at once.  A hit is only a claim: the format's validator then walks the
structure (chunk lengths and checksums, block chains, header sizes) and returns
the length of the item or nothing.  The item that starts at byte 0 corrects the
declared type; items found elsewhere are carved as embedded media.

``store_samples`` writes any bytes as 8-bit mono PCM (RIFF/WAVE) with native
expressions and ``read_samples`` takes them back through the sniffer.

Defined cases: null content has no items and type null; empty or unknown bytes
have type null; where nothing is declared, declared_ok is null; overlapping
claims all count, an item inside another has a larger ``depth``; of two formats
that claim the same bytes the one first in the alphabet gives the type; rows are mapped one by one, so an empty table gives an empty
table and repeated rows repeated results.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pixloom.llm.common import bounded_batches, lean, small_batches, utf8

FRAME = 192  # payloads are padded to a multiple of this
RATE = 8000

# --- validators: start of a claimed item -> its end, or None -----------------


def png_end(data: bytes, at: int) -> int | None:
    at += 8
    first = True
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data) or first and (kind != b"IHDR" or size != 13):
            return None
        if zlib.crc32(data[at + 4 : at + 8 + size]) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            return None
        at, first = at + 12 + size, False
        if kind == b"IEND":
            return at
    return None


def gif_end(data: bytes, at: int) -> int | None:
    def blocks(at: int) -> int | None:
        while at < len(data):
            size = data[at]
            at += 1 + size
            if not size:
                return at
        return None

    if at + 13 > len(data):
        return None
    flags = data[at + 10]
    at += 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    frames = 0
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            return at + 1 if frames else None
        if kind == 0x21:
            following = blocks(at + 2)
        elif kind == 0x2C and at + 10 < len(data):
            local = data[at + 9]
            frames += 1
            following = blocks(at + 11 + (3 << (local & 7) + 1 if local & 128 else 0))
        else:
            return None
        if following is None:
            return None
        at = following
    return None


def jpeg_end(data: bytes, at: int) -> int | None:
    at += 2
    frame = False
    while at + 4 <= len(data) + 2 and data[at] == 0xFF:
        while at + 2 < len(data) and data[at + 1] == 0xFF:  # bytes that may fill up to a marker
            at += 1
        marker = data[at + 1]
        if marker == 0xD9:
            return at + 2 if frame else None
        if at + 4 > len(data):
            return None
        size = struct.unpack_from(">H", data, at + 2)[0]
        if size < 2 or at + 2 + size > len(data):
            return None
        frame |= 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)  # tables and the like are no frames
        at += 2 + size
        if marker == 0xDA:  # entropy-coded data goes on to the next marker that is neither stuffed nor a restart
            while (at := data.find(b"\xff", at)) >= 0:
                if at + 1 >= len(data):
                    return None
                if data[at + 1] == 0xD9:
                    return at + 2 if frame else None
                if data[at + 1] == 0xFF:
                    at += 1
                    continue
                if data[at + 1] and not 0xD0 <= data[at + 1] <= 0xD7:
                    break
                at += 2
            if at < 0:
                return None
    return None


def riff_end(form: bytes) -> Callable[[bytes, int], int | None]:
    def end(data: bytes, at: int) -> int | None:
        if data[at + 8 : at + 12] != form:
            return None
        stop = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        if stop > len(data):
            return None
        at += 12
        while at + 8 <= stop:
            size = struct.unpack_from("<I", data, at + 4)[0]
            at += 8 + size + size % 2
        return stop if at == stop else None

    return end


def bmp_end(data: bytes, at: int) -> int | None:
    if at + 30 > len(data):
        return None
    size, _, offset, header = struct.unpack_from("<IIII", data, at + 2)
    planes, bits = struct.unpack_from("<HH", data, at + 26)
    sound = header in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32)
    return at + size if sound and 14 + header <= offset <= size and at + size <= len(data) else None


def gzip_end(data: bytes, at: int) -> int | None:
    stream = zlib.decompressobj(31)
    rest = memoryview(data)[at:]
    try:
        while len(rest) and not stream.eof:
            stream.decompress(rest, 1 << 16)  # bounded memory, whatever the stream expands to
            rest = stream.unconsumed_tail
    except zlib.error:
        return None
    return len(data) - len(stream.unused_data) if stream.eof else None


FORMATS: tuple[tuple[str, bytes, Callable[[bytes, int], int | None]], ...] = (
    ("png", b"\x89PNG\r\n\x1a\n", png_end),
    ("gif", b"GIF87a", gif_end),
    ("gif", b"GIF89a", gif_end),
    ("jpeg", b"\xff\xd8\xff", jpeg_end),
    ("wav", b"RIFF", riff_end(b"WAVE")),
    ("webp", b"RIFF", riff_end(b"WEBP")),
    ("bmp", b"BM", bmp_end),
    ("gzip", b"\x1f\x8b\x08", gzip_end),
)


@functools.cache
def automaton() -> ahocorasick.Automaton:
    by_magic: dict[str, list[int]] = {}
    for k, (_, magic, _) in enumerate(FORMATS):
        by_magic.setdefault(magic.decode("latin-1"), []).append(k)
    made = ahocorasick.Automaton()
    for magic, formats in by_magic.items():
        made.add_word(magic, (len(magic), formats))
    made.make_automaton()
    return made


def sniff(data: bytes) -> list[tuple[str, int, int, int]]:
    """(format, start, length, depth) of each valid item, by start; depth counts the items around it."""
    found = []
    for last, (size, formats) in automaton().iter(data.decode("latin-1")):
        start = last - size + 1
        for k in formats:
            name, _, end = FORMATS[k]
            if (stop := end(data, start)) is not None:
                found.append((start, -stop, name))
    items, around = [], []
    for start, stop, name in sorted(found):
        around = [e for e in around if e >= -stop]
        items.append((name, start, -stop - start, len(around)))
        around.append(-stop)
    return items


ITEM = pa.struct([("format", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("depth", pa.int32())])


def sniff_column(df: DataFrame, content_col: str = "content", declared_col: str | None = None) -> DataFrame:
    """All columns plus ``media_type``, ``declared_ok`` and ``media`` (the items; carve with ``carve``).

    Columns of those names in the input are replaced.
    """
    kept = [c for c in df.columns if c not in ("media_type", "declared_ok", "media")]
    at, declared = kept.index(content_col), kept.index(declared_col) if declared_col else None

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            items = [sniff(x) if x else [] for x in batch.column(at).to_pylist()]
            kinds = [next((i[0] for i in found if i[1] == 0), None) for found in items]
            claims = batch.column(declared).to_pylist() if declared is not None else [None] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns, pa.array(kinds, pa.string()),
                    pa.array([None if c is None else k == c for k, c in zip(kinds, claims)], pa.bool_()),
                    pa.array([[dict(zip(("format", "start", "length", "depth"), i)) for i in f] for f in items], pa.list_(ITEM)),
                ],
                names=[*kept, "media_type", "declared_ok", "media"],
            )

    schema = df.select(*[f"`{c}`" for c in kept]).schema
    for field in StructType.fromDDL("media_type string, declared_ok boolean, media array<struct<format: string, start: long, length: long, depth: int>>"):
        schema = schema.add(field)
    return bounded_batches(df).select(*[f"`{c}`" for c in kept]).mapInArrow(lean(look), schema)


def carve(df: DataFrame, content_col: str = "content") -> DataFrame:
    """One row for each embedded item of ``sniff_column``, with its bytes."""
    return df.select("*", F.explode(F.filter("media", lambda m: m["start"] > 0)).alias("item")).withColumn(
        "item_content", F.substring(F.col(content_col), (F.col("item.start") + 1).cast("int"), F.col("item.length").cast("int"))
    )


def _little(value: Column, size: int) -> Column:
    return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftrightunsigned(value, 8 * i).bitwiseAND(F.lit(255))), 2, "0")) for i in range(size)])


def padded(data: Column) -> Column:
    """Spaces up to a positive multiple of FRAME."""
    n = F.octet_length(data)
    short = F.when(n == 0, F.lit(FRAME)).otherwise(F.pmod(-n, F.lit(FRAME)))
    return F.concat(data, F.repeat(F.lit(" "), short).cast("binary"))


def store_samples(payload: Column) -> Column:
    """Bytes as the samples of an 8-bit mono WAVE file; native.  The payload's length must be even."""
    n = F.octet_length(payload).cast("long")
    fixed = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data"
    return F.concat(F.lit(b"RIFF"), _little(n + 36, 4), F.lit(fixed), _little(n, 4), payload)


def samples(data: bytes, items: Iterable[dict]) -> bytes:
    """The samples of the WAVE item at byte 0, by its chunks."""
    item = next(i for i in items if i["start"] == 0 and i["format"] == "wav")
    at = 12
    while at < item["length"]:
        kind, size = struct.unpack_from("<4sI", data, at)
        if kind == b"data":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def feature(payload: bytes, items: list[dict]) -> str:
    x = np.frombuffer(payload, np.uint8)
    embedded = sum(i["start"] > 0 for i in items)
    return f"wav;frames={len(x) // FRAME};min={x.min()};max={x.max()};mean={x.mean(dtype=np.float64):.6f};embedded={embedded}"


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as samples, sniff what was stored, read it back and digest it."""
    stored = docs.select(F.col(id_col).cast("long").alias(id_col), utf8(text_col).alias("__b")).select(
        id_col, F.octet_length("__b").cast("long").alias("n_bytes"),
        store_samples(padded(F.col("__b"))).alias("content"), F.lit("wav").alias("declared"),
    )

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = []
            for r in batch.to_pylist():
                payload = samples(r["content"], r["media"])
                rows.append({
                    id_col: r[id_col], "n_bytes": r["n_bytes"], "payload_bytes": len(payload),
                    "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]),
                    "media_bytes": len(r["content"]), "media_sha256": hashlib.sha256(r["content"]).hexdigest(),
                    "feature": feature(payload, r["media"]), "media_type": r["media_type"], "declared_ok": r["declared_ok"],
                })
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    out = pa.schema([
        (id_col, pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
        ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
        ("media_type", pa.string()), ("declared_ok", pa.bool_()),
    ])
    return sniff_column(stored, "content", "declared").mapInArrow(
        lean(digest),
        f"`{id_col}` long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string, media_type string, declared_ok boolean",
    )
