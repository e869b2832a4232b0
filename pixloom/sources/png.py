"""PNG by zlib and numpy: palettes are kept on reading, writing is always 8-bit RGB."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"\x89PNG\r\n\x1a\n"
_ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def write(raster: np.ndarray) -> bytes:
    """A raster of rows x columns x 3."""
    height, width, _ = raster.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.concatenate((np.zeros((height, 1), np.uint8), raster.reshape(height, -1).astype(np.uint8)), axis=1)
    return MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def _unfilter(data: bytes, rows: int, stride: int, step: int) -> np.ndarray:
    out = np.zeros((rows + 1, stride + step), np.int64)
    for r in range(rows):
        kind = data[r * (stride + 1)]
        line = np.frombuffer(data, np.uint8, stride, r * (stride + 1) + 1).astype(np.int64)
        above, here = out[r], out[r + 1]
        if kind == 0:
            here[step:] = line
        elif kind == 2:
            here[step:] = (line + above[step:]) & 255
        elif kind == 1:
            for k in range(step):
                here[step + k :: step] = np.cumsum(line[k::step]) & 255
        else:
            for i in range(stride):
                a, b, c = int(here[i]), int(above[i + step]), int(above[i])
                if kind == 3:
                    guess = (a + b) // 2
                elif kind == 4:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                else:
                    raise ValueError("unknown filter")
                here[i + step] = (int(line[i]) + guess) & 255
    return out[1:, step:].astype(np.uint8)


def _samples(packed: np.ndarray, depth: int, count: int) -> np.ndarray:
    """Samples of each row, 16-bit ones cut to their high byte."""
    if depth == 8:
        return packed[:, :count]
    if depth == 16:
        return packed[:, 0 : 2 * count : 2]
    bits = np.unpackbits(packed, axis=1).reshape(len(packed), -1, depth)
    return (bits << np.arange(depth - 1, -1, -1)).sum(axis=2).astype(np.uint8)[:, :count]


def read(data: bytes, background: tuple[int, int, int] | None = None) -> dict:
    """width, height, raster (RGB, gray or indices), palette or None, transparent index or -1, whether it is gray.

    Alpha is blended on the given background, else the file's, else black; so is
    a colour that the file calls transparent.  Grays without either stay grays.
    """
    if data[:8] != MAGIC:
        raise ValueError("not a PNG")
    chunks: dict[bytes, bytes] = {}
    at = 8
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) != size or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("a chunk is damaged")
        chunks[kind] = chunks.get(kind, b"") + body
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
    planes = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = zlib.decompress(chunks[b"IDAT"])
    image = np.zeros((height, width, planes), np.uint8)
    start = 0
    for x0, y0, dx, dy in _ADAM7 if interlaced else ((0, 0, 1, 1),):
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w <= 0 or h <= 0:
            continue
        stride = (w * planes * depth + 7) // 8
        lines = _unfilter(raw[start : start + h * (stride + 1)], h, stride, max(1, planes * depth // 8))
        image[y0::dy, x0::dx] = _samples(lines, depth, w * planes).reshape(h, w, planes)
        start += h * (stride + 1)
    trns = chunks.get(b"tRNS", b"")
    back = np.array(background or (0, 0, 0), np.int64)
    if colour == 3:
        palette = np.frombuffer(chunks[b"PLTE"], np.uint8).reshape(-1, 3).astype(np.int64)
    if background is None and b"bKGD" in chunks:
        said = chunks[b"bKGD"]
        if colour == 3:
            back = palette[said[0]] if said and said[0] < len(palette) else back
        else:
            values = [v >> 8 if depth == 16 else v * 255 // ((1 << depth) - 1) for v in struct.unpack(f">{len(said) // 2}H", said)]
            back = np.array(values * 3 if colour in (0, 4) else values, np.int64)
    if colour == 3:
        if trns:
            alpha = np.frombuffer(trns, np.uint8).astype(np.int64)[:, None]
            palette[: len(alpha)] = (255 - alpha) * back + alpha * palette[: len(alpha)] >> 8
        transparent = int(np.argmin(np.frombuffer(trns, np.uint8))) if trns and 0 in trns else -1
        return {
            "width": width, "height": height, "raster": image[:, :, 0], "palette": palette.astype(np.uint8), "transparent": transparent, "gray": False,
        }
    key = None
    if trns and colour in (0, 2):
        wanted = np.array([v >> 8 if depth == 16 else v for v in struct.unpack(f">{len(trns) // 2}H", trns)], np.uint8)
        key = (image == wanted).all(axis=2, keepdims=True)
    if depth < 8:
        image = (image.astype(np.int64) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    if colour in (0, 4):
        rgb, alpha = np.repeat(image[:, :, :1], 3, axis=2), image[:, :, 1:2] if colour == 4 else None
    else:
        rgb, alpha = image[:, :, :3], image[:, :, 3:4] if colour == 6 else None
    if alpha is not None:
        a = alpha.astype(np.int64)
        rgb = (rgb * a + back * (255 - a) >> 8).astype(np.uint8)
    elif key is not None:
        rgb = np.where(key, back, rgb).astype(np.uint8)
    gray = colour == 0 and key is None
    return {"width": width, "height": height, "raster": rgb[:, :, 0] if gray else rgb, "palette": None, "transparent": -1, "gray": gray}
