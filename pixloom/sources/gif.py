"""GIF: LZW rasters, interlace, disposal; one file gives its frames in order."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np


def lzw(data: bytes, root: int, size: int) -> np.ndarray:
    """``size`` indices; a stream that ends early leaves zeros."""
    clear, end = 1 << root, (1 << root) + 1
    table: list[bytes] = []
    out = bytearray()
    width, bits, held, before = root + 1, 0, 0, None
    table = [bytes((i,)) for i in range(clear)] + [b"", b""]
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= width:
            code = held & (1 << width) - 1
            held >>= width
            bits -= width
            if code == clear:
                table = table[: clear + 2]
                width, before = root + 1, None
                continue
            if code == end or len(out) >= size:
                return _padded(out, size)
            if before is None:
                entry = table[code]
            elif code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = before + before[:1]
            else:
                raise ValueError("a code beyond the table")
            out += entry
            if before is not None and len(table) < 4096:
                table.append(before + entry[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
            before = entry
    return _padded(out, size)


def _padded(out: bytearray, size: int) -> np.ndarray:
    return np.frombuffer(bytes(out[:size]).ljust(size, b"\0"), np.uint8)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _rows(height: int, interlaced: bool) -> list[int]:
    """Screen rows in the order of the stream."""
    if not interlaced:
        return list(range(height))
    return [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, height, step)]


def frames(data: bytes, background: tuple[int, int, int] | None = None) -> Iterator[dict]:
    """frame_no, delay (hundredths of a second), loops (None: once, 0: endless), raster of the whole screen."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, back_index = struct.unpack_from("<HHBB", data, 6)
    at = 13
    table = None

    def colours(flags: int, at: int) -> tuple[np.ndarray, int]:
        n = 2 << (flags & 7)
        return np.frombuffer(data, np.uint8, n * 3, at).reshape(-1, 3), at + n * 3

    if flags & 128:
        table, at = colours(flags, at)
    back = np.array(background if background is not None else table[back_index] if table is not None and back_index < len(table) else (0, 0, 0), np.uint8)
    canvas = np.broadcast_to(back, (height, width, 3)).copy()
    delay, disposal, clear, loops, number = 0, 0, -1, None, 0
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            body, after = _blocks(data, at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, struct.unpack_from("<H", body, 1)[0]
                clear = body[3] if body[0] & 1 else -1
            elif data[at + 1] == 0xFF and body[:11] in (b"NETSCAPE2.0", b"ANIMEXTS1.0") and len(body) >= 14:
                loops = struct.unpack_from("<H", body, 12)[0]
            at = after
            continue
        if kind != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        own = table
        if local & 128:
            own, at = colours(local, at)
        if own is None:
            raise ValueError("no colour table")
        if left + w > width or top + h > height:
            raise ValueError("a frame leaves the screen")
        root = data[at]
        body, at = _blocks(data, at + 1)
        indices = np.zeros((h, w), np.uint8)
        indices[_rows(h, bool(local & 64))] = lzw(body, root, w * h).reshape(h, w)
        before = canvas.copy()
        drawn = indices != clear
        area = canvas[top : top + h, left : left + w]
        area[drawn] = own[np.minimum(indices, len(own) - 1)][drawn]
        yield {"frame_no": number, "delay": delay, "loops": loops, "width": width, "height": height, "raster": canvas.copy()}
        if disposal == 2:
            area[drawn] = back
        elif disposal == 3:
            canvas = before
        delay, disposal, clear, number = 0, 0, -1, number + 1
