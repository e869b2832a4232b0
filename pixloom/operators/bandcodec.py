"""The six-row terminal graphics stream: indexed rasters to bytes and back.

Both directions are sequential inside one picture, so a picture is a row and
pictures are mapped over.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixloom.operators.bands import GAP
from pixloom.operators.quantize import terminal_palette

SIDE_LIMIT = 1_000_000
REPEAT_LIMIT = 0xFFFF
PARAMETERS = 16


@dataclass(frozen=True)
class Style:
    """How a stream is written."""

    eight_bit: bool = False
    envelope: bool = True
    hls: bool = False
    body_only: bool = False
    limit_255: bool = False  # repeat counts of at most 255
    fill: bool = False  # first pass paints whole intervals, later ones paint over them
    transparent: int = -1


def _percent(v: int) -> int:
    return (v * 100 + 127) // 255


def hls_of(r: int, g: int, b: int) -> tuple[int, int, int]:
    top, low = max(r, g, b), min(r, g, b)
    spread, light = top - low, ((top + low) * 100 + 255) // 510
    if not spread:
        return 0, light, 0
    sat = spread * 100 // (top + low if light < 50 else 510 - top - low)
    start, a, c = (120, g, b) if r == top else (240, b, r) if g == top else (360 if r < g else 0, r, g)
    return start + int((a - c) * 60 / spread), light, sat


def colour_definitions(palette: np.ndarray, style: Style) -> str:
    out = []
    for i, (r, g, b) in enumerate(palette.tolist()):
        if i != style.transparent:
            values = hls_of(r, g, b) if style.hls else (_percent(r), _percent(g), _percent(b))
            out.append(f"#{i};{1 if style.hls else 2};{';'.join(map(str, values))}")
    return "".join(out)


def run_lengths(bits: np.ndarray, style: Style) -> str:
    """Columns of six bits as characters, runs of more than three counted."""
    if not len(bits):
        return ""
    at = np.flatnonzero(np.concatenate(([True], bits[1:] != bits[:-1])))
    out = []
    for start, n in zip(at.tolist(), np.diff(np.append(at, len(bits))).tolist()):
        char = chr(63 + int(bits[start]))
        if style.limit_255:
            while n > 255:
                out.append(f"!255{char}")
                n -= 255
        out.append(f"!{n}{char}" if n > 3 else char * n)
    return "".join(out)


def intervals_of(band: np.ndarray, colours: np.ndarray) -> list[tuple[int, int, int, np.ndarray]]:
    """(start, -end, colour, bits) of a band's islands in drawing order; bands are up to six rows of indices."""
    nodes = []
    weights = (1 << np.arange(len(band)))[:, None]
    for c in colours.tolist():
        bits = ((band == c) * weights).sum(axis=0)
        filled = np.flatnonzero(bits)
        breaks = np.flatnonzero(np.diff(filled) > GAP)
        for a, b in zip(filled[np.concatenate(([0], breaks + 1))], filled[np.concatenate((breaks, [-1]))]):
            nodes.append((int(a), -int(b) - 1, c, bits))
    return sorted(nodes, key=lambda n: n[:3])


def body(indices: np.ndarray, ncolors: int, style: Style = Style()) -> str:
    """All bands of a raster (rows x columns)."""
    drawn = (indices < ncolors) & (indices != style.transparent)
    named = ncolors != 2 or style.transparent == -1
    out: list[str] = []
    active = -1
    for top in range(0, len(indices), 6):
        band, shown = indices[top : top + 6], drawn[top : top + 6]
        if top:
            out.append("-")
        full = (1 << len(band)) - 1
        filling = style.fill and bool(shown.all())
        rest = intervals_of(np.where(shown, band, -1), np.unique(band[shown]))
        x = 0
        while rest:
            if x > rest[0][0]:
                out.append("$")
                x = 0
            later = []
            for node in rest:
                start, end, colour, bits = node
                if start < x:
                    later.append(node)
                    continue
                if named and colour != active:
                    out.append(f"#{colour}")
                    active = colour
                ink = np.full(-end - start, full) if filling else bits[start:-end]
                out.append(run_lengths(np.concatenate((np.zeros(start - x, np.int64), ink)), style))
                x = -end
            rest, filling = later, False
    return "".join(out)


def encode(indices: np.ndarray, palette: np.ndarray, style: Style = Style()) -> bytes:
    """A whole stream: header, colours, bands, end."""
    height, width = indices.shape
    ncolors = len(palette)
    if ncolors < 1 or not 0 < width <= SIDE_LIMIT or not 0 < height <= SIDE_LIMIT:
        raise ValueError("bad argument")
    start = ("\x90" if style.eight_bit else "\x1bP") if style.envelope else ""
    stop = ("\x9c" if style.eight_bit else "\x1b\\") if style.envelope else ""
    colours = "" if style.body_only or ncolors == 2 and style.transparent != -1 else colour_definitions(palette, style)
    return f'{start}q"1;1;{width};{height}{colours}{body(indices.astype(np.int64), ncolors, style)}{stop}'.encode("latin-1")


def wrapped(data: bytes, size: int = 256) -> bytes:
    """The stream in device control strings of at most ``size`` bytes, for a multiplexer that passes them on."""
    room = size - 4
    return b"".join(b"\x1bP" + data[at : at + room] + b"\x1b\\" for at in range(0, len(data), room))


# --- reading -------------------------------------------------------------------

_ITEM = re.compile(rb'"(?P<raster>[0-9;]*)|!(?P<repeat>[0-9]*)|#(?P<colour>[0-9;]*)|(?P<ink>[?-~])|(?P<move>[$-])|(?P<escape>\x1b)', re.S)
_START = re.compile(rb"(?:\x1bP|\x90)[0-9;]*q")


class BadStream(ValueError):
    pass


def hls_rgb(h: int, light: int, sat: int) -> tuple[int, int, int]:
    """Whole per cents of a colour given by hue (blue at 0 degrees), lightness and saturation."""
    half = sat * (1.0 - abs(2 * light / 100.0 - 1.0)) / 2.0
    top, low = light + half, light - half
    hue = (h + 240) % 360
    k, part = divmod(hue, 60)
    up, down = low + (top - low) * (part / 60.0), low + (top - low) * ((60 - part) / 60.0)
    return tuple(int(v) for v in ((top, up, low), (down, top, low), (low, top, up), (low, down, top), (up, low, top), (top, low, down))[k])


def _numbers(text: bytes) -> list[int]:
    values = [int(t) if t else 0 for t in text.split(b";")][:PARAMETERS]
    if any(v > 2**31 - 1 for v in values):
        raise BadStream("integer overflow")
    return values


def render(data: bytes) -> np.ndarray:
    """The colours (rows x columns x 3) as drawn, also of streams that define a register more than once; black where nothing was."""
    return _draw(data, True)[2]


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Indices (rows x columns) and palette of a stream; 255 where nothing was drawn."""
    return _draw(data, False)[:2]


def _draw(data: bytes, paint: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Indices, the palette up to the highest colour drawn, the picture if painted, and the palette up to the highest colour drawn or defined."""
    start = _START.search(data)
    if not start:
        raise BadStream("no stream starts here")
    palette = np.array(terminal_palette(), np.int64)
    canvas = np.full((6, 64), 255, np.uint8)
    strokes: list[tuple[int, int, int, list[int], np.ndarray]] = []
    x = y = width = height = most = defined = 0
    colour, repeat, raster = 15, 1, (0, 0)
    at = start.end()
    while m := _ITEM.search(data, at):
        at, kind = m.end(), m.lastgroup
        if kind == "escape":
            break
        if kind == "ink":
            if x + repeat > SIDE_LIMIT or y + 6 > SIDE_LIMIT:
                raise BadStream("the cursor leaves the largest picture")
            most = max(most, colour)
            bits = m["ink"][0] - 63
            if bits:
                rows = [i for i in range(6) if bits >> i & 1]
                while x + repeat > canvas.shape[1]:
                    canvas = np.hstack((canvas, np.full_like(canvas, 255)))
                while y + 6 > canvas.shape[0]:
                    canvas = np.vstack((canvas, np.full_like(canvas, 255)))
                canvas[[y + i for i in rows], x : x + repeat] = colour
                if paint:
                    strokes.append((y, x, x + repeat, rows, palette[colour].copy()))
                width, height = max(width, x + repeat), max(height, y + rows[-1] + 1)
            x, repeat = x + repeat, 1
        elif kind == "repeat":
            repeat = (_numbers(m["repeat"]) or [1])[0] or 1
            if repeat > REPEAT_LIMIT:
                raise BadStream("the repeat count is too large")
        elif kind == "move":
            x, y = 0, y + 6 * (m["move"] == b"-")
            if y > SIDE_LIMIT:
                raise BadStream("the cursor leaves the largest picture")
        elif kind == "raster":
            values = _numbers(m["raster"])
            raster = tuple(values[2:4]) if len(values) > 3 else (values[2], raster[1]) if len(values) > 2 else raster
            if max(raster) > SIDE_LIMIT:
                raise BadStream("the picture is too large")
        else:
            values = _numbers(m["colour"])
            colour = min(values[0], 255)
            if len(values) > 4:
                percent = hls_rgb(min(values[2], 360), min(values[3], 100), min(values[4], 100)) if values[1] == 1 else tuple(min(v, 100) for v in values[2:5])
                if values[1] in (1, 2):
                    palette[colour] = [(v * 255 + 50) // 100 for v in percent]
                    defined = max(defined, colour)
    width, height = max(width, raster[0]), max(height, raster[1])
    out = np.full((height, width), 255, np.uint8)
    part = canvas[:height, :width]
    out[: part.shape[0], : part.shape[1]] = part
    painted = np.zeros((height, width, 3) if paint else (0, 0, 3), np.uint8)
    for top, left, right, rows, rgb in strokes:
        painted[[top + i for i in rows], left:right] = rgb
    palette = palette.astype(np.uint8)
    return out, palette[: max(most + 1, 3)], painted, palette[: max(most + 1, defined + 1, 3)]


# --- DataFrame forms -------------------------------------------------------------


def encode_frames(indexed: DataFrame, style: Style = Style()) -> DataFrame:
    """image_id and data of frames with indices and palette; a frame that cannot be written has data null and a message."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                try:
                    raster = np.frombuffer(r["indices"], np.uint8).reshape(r["height"], r["width"])
                    out.append((encode(raster, np.frombuffer(r["palette"], np.uint8).reshape(-1, 3), style), None))
                except ValueError as e:
                    out.append((None, str(e)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())],
                names=["image_id", "data", "message"],
            )

    return indexed.select("image_id", "width", "height", "indices", "palette").mapInArrow(run, "image_id long, data binary, message string")


def decode_streams(streams: DataFrame, data_col: str = "data") -> DataFrame:
    """image_id, width, height, indices, palette, ncolors, registers; faulty streams have a message and nulls.

    The palette ends with the highest colour drawn; ``registers`` has those that the stream defines beyond it too.
    """
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.string()]
    names = ["image_id", "width", "height", "indices", "palette", "ncolors", "registers", "message"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for image, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    raster, palette, _, registers = _draw(data or b"", False)
                    out.append((image, raster.shape[1], raster.shape[0], raster.tobytes(), palette.tobytes(), len(palette), registers.tobytes(), None))
                except BadStream as e:
                    out.append((image, None, None, None, None, None, None, str(e)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return streams.select("image_id", F.col(data_col)).mapInArrow(
        run, "image_id long, width int, height int, indices binary, palette binary, ncolors long, registers binary, message string"
    )
