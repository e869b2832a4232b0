"""Plain bitmap formats by numpy: BMP, TGA, WBMP, PSD, Radiance HDR and Softimage PIC, all to RGB rasters."""

from __future__ import annotations

import re
import struct

import numpy as np


def _fits(data: bytes, at: int, size: int) -> bytes:
    if size < 0 or at < 0 or at + size > len(data):
        raise ValueError("the file is cut short")
    return data[at : at + size]


def _checked(width: int, height: int) -> tuple[int, int]:
    if not 0 < width <= 1 << 24 or not 0 < height <= 1 << 24 or width * height > 1 << 28:
        raise ValueError("a picture of this size cannot be read")
    return width, height


def _field(values: np.ndarray, mask: int) -> np.ndarray:
    """The bits of a mask as 0 to 255."""
    if not mask:
        return np.zeros(values.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    top = mask >> low
    return ((values & mask) >> low).astype(np.int64) * 255 // top


def bmp(data: bytes) -> np.ndarray:
    """Uncompressed and bit-field bitmaps of 1, 4, 8, 16, 24 and 32 bits, and run lengths of 4 and 8 bits."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP")
    offset, header = struct.unpack("<II", _fits(data, 10, 8))
    if header == 12:
        width, height, _, bits = struct.unpack("<HhHH", _fits(data, 18, 8))
        packing, used = 0, 0
    else:
        width, height, _, bits, packing = struct.unpack("<iiHHI", _fits(data, 18, 16))
        used = struct.unpack("<I", _fits(data, 46, 4))[0]
    down, height = height < 0, abs(height)
    _checked(width, height)
    after = 14 + header
    masks = {16: (0x7C00, 0x3E0, 0x1F), 32: (0xFF0000, 0xFF00, 0xFF)}.get(bits)
    if packing == 3:
        masks = struct.unpack("<III", _fits(data, 54, 12))
        after += 12 if header == 40 else 0
    elif packing not in (0, 1, 2):
        raise ValueError("this BMP packing cannot be read")
    if bits <= 8:
        step = 3 if header == 12 else 4
        size = max(0, min(used or 1 << bits, 256, (offset - after) // step))
        table = np.zeros((256, 3), np.uint8)
        table[:size] = np.frombuffer(_fits(data, after, size * step), np.uint8).reshape(size, step)[:, 2::-1]
    if packing in (1, 2):
        raster = table[_bmp_runs(data, offset, width, height, bits)]
    else:
        stride = (width * bits + 31) // 32 * 4
        lines = np.frombuffer(_fits(data, offset, stride * height), np.uint8).reshape(height, stride)
        if bits in (1, 4, 8):
            parts = np.unpackbits(lines, axis=1).reshape(height, -1, bits)[:, :width]
            raster = table[(parts << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2)]
        elif bits == 24:
            raster = lines[:, : width * 3].reshape(height, width, 3)[:, :, ::-1]
        elif masks:
            words = np.ascontiguousarray(lines[:, : width * bits // 8]).view(f"<u{bits // 8}").astype(np.int64)
            raster = np.stack([_field(words, m) for m in masks], axis=2).astype(np.uint8)
        else:
            raise ValueError("this BMP depth cannot be read")
    return np.ascontiguousarray(raster if down else raster[::-1])


def _bmp_runs(data: bytes, at: int, width: int, height: int, bits: int) -> np.ndarray:
    out = np.zeros((height, width), np.uint8)
    x = y = 0

    def put(values: list[int]) -> None:
        nonlocal x
        if y < height:
            out[y, x : x + len(values)] = values[: max(0, width - x)]
        x += len(values)

    def split(raw: bytes, n: int) -> list[int]:
        return list(raw[:n]) if bits == 8 else [v for b in raw for v in (b >> 4, b & 15)][:n]

    while at + 2 <= len(data):
        n, v = data[at], data[at + 1]
        at += 2
        if n:
            put(split(bytes([v]) * n, n))
        elif v == 0:
            x, y = 0, y + 1
        elif v == 1:
            break
        elif v == 2:
            dx, dy = _fits(data, at, 2)
            x, y, at = x + dx, y + dy, at + 2
        else:
            size = v if bits == 8 else (v + 1) // 2
            put(split(_fits(data, at, size), v))
            at += size + size % 2
    return out


def tga(data: bytes) -> np.ndarray:
    """Mapped, true-colour and gray pictures, plain or with run lengths."""
    id_size, mapped, kind, first, entries, entry_bits, _, _, width, height, bits, flags = struct.unpack("<BBBHHBHHHHBB", _fits(data, 0, 18))
    if kind not in (1, 2, 3, 9, 10, 11) or bits not in (8, 15, 16, 24, 32):
        raise ValueError("this TGA kind cannot be read")
    _checked(width, height)
    at = 18 + id_size

    def colours(raw: np.ndarray, depth: int) -> np.ndarray:
        """Pixels as rows of bytes to RGB."""
        if depth in (15, 16):
            word = raw[:, 0].astype(np.int64) | raw[:, 1].astype(np.int64) << 8
            return np.stack([(word >> s & 31) * 255 // 31 for s in (10, 5, 0)], axis=1).astype(np.uint8)
        return np.repeat(raw[:, :1], 3, axis=1) if depth == 8 else raw[:, 2::-1]

    table = None
    if mapped:
        step = (entry_bits + 7) // 8
        table = colours(np.frombuffer(_fits(data, at, entries * step), np.uint8).reshape(-1, step), entry_bits)
        at += entries * step
    step, wanted = (bits + 7) // 8, width * height
    if kind < 8:
        raw = np.frombuffer(_fits(data, at, wanted * step), np.uint8).reshape(-1, step)
    else:
        parts, have = [], 0
        while have < wanted:
            head = _fits(data, at, 1)[0]
            n, run = (head & 127) + 1, head & 128
            part = _fits(data, at + 1, step if run else n * step)
            parts.append(part * n if run else part)
            have, at = have + n, at + 1 + len(part)
        raw = np.frombuffer(b"".join(parts), np.uint8)[: wanted * step].reshape(-1, step)
    if kind & 7 == 1:
        if table is None or bits != 8:
            raise ValueError("this TGA has no usable map")
        place = raw[:, 0].astype(np.int64) - first
        if len(place) and (place.min() < 0 or place.max() >= len(table)):
            raise ValueError("an index lies beyond the map")
        rgb = table[place]
    else:
        rgb = colours(raw, bits)
    raster = rgb.reshape(height, width, 3)
    raster = raster if flags & 32 else raster[::-1]
    return np.ascontiguousarray(raster[:, ::-1] if flags & 16 else raster)


def wbmp(data: bytes) -> np.ndarray:
    """Wireless bitmaps of kind 0: one bit a pixel, 1 is white."""
    def number(at: int) -> tuple[int, int]:
        value = 0
        while True:
            byte = _fits(data, at, 1)[0]
            value, at = value << 7 | byte & 127, at + 1
            if not byte & 128:
                return value, at

    if data[:2] != b"\x00\x00":
        raise ValueError("not a WBMP")
    width, at = number(2)
    height, at = number(at)
    _checked(width, height)
    stride = (width + 7) // 8
    bits = np.unpackbits(np.frombuffer(_fits(data, at, stride * height), np.uint8).reshape(height, stride), axis=1)[:, :width]
    return np.repeat((bits * 255).astype(np.uint8)[:, :, None], 3, axis=2)


def psd(data: bytes) -> np.ndarray:
    """The merged picture of 8- and 16-bit RGB and gray documents; alpha is blended on white."""
    magic, version, channels, height, width, depth, mode = struct.unpack(">4sH6xHIIHH", _fits(data, 0, 26))
    if magic != b"8BPS" or version != 1 or mode not in (1, 3) or depth not in (8, 16) or not channels:
        raise ValueError("this PSD cannot be read")
    _checked(width, height)
    at = 26
    for _ in range(3):
        at += 4 + struct.unpack(">I", _fits(data, at, 4))[0]
    packing = struct.unpack(">H", _fits(data, at, 2))[0]
    at += 2
    wide = depth // 8
    if packing == 0:
        raw = np.frombuffer(_fits(data, at, channels * height * width * wide), np.uint8).reshape(channels, height, width * wide)
    elif packing == 1:
        sizes = struct.unpack(f">{channels * height}H", _fits(data, at, 2 * channels * height))
        at += 2 * channels * height
        lines = []
        for size in sizes:
            lines.append(_packbits(_fits(data, at, size), width * wide))
            at += size
        raw = np.frombuffer(b"".join(lines), np.uint8).reshape(channels, height, width * wide)
    else:
        raise ValueError("this PSD packing cannot be read")
    planes = raw[:, :, ::wide]
    colours = planes[:3] if mode == 3 and channels >= 3 else np.repeat(planes[:1], 3, axis=0)
    rgb = np.moveaxis(colours, 0, 2)
    if mode == 3 and channels >= 4:
        alpha = planes[3].astype(np.int64)[:, :, None]
        # The merged picture stands on white already: its colours are taken as they are where nothing shows through.
        rgb = np.where(alpha == 0, 255, rgb).astype(np.uint8)
    return np.ascontiguousarray(rgb)


def _packbits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size and at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    if len(out) < size:
        raise ValueError("the file is cut short")
    return bytes(out[:size])


def hdr(data: bytes) -> np.ndarray:
    """Radiance pictures with a common exponent, to 8 bits by a gamma of 2.2."""
    m = re.match(rb"#\?(?:RADIANCE|RGBE)\n(?:.*\n)*?\n-Y (\d+) \+X (\d+)\n", data)
    if not m or b"FORMAT=32-bit_rle_rgbe" not in m[0]:
        raise ValueError("this HDR cannot be read")
    height, width = int(m[1]), int(m[2])
    _checked(width, height)
    at, rows = m.end(), []
    for _ in range(height):
        head = data[at : at + 4]
        if len(head) == 4 and head[:2] == b"\x02\x02" and (head[2] << 8 | head[3]) == width and 8 <= width < 32768:
            at += 4
            planes = []
            for _ in range(4):
                line = bytearray()
                while len(line) < width:
                    n = _fits(data, at, 1)[0]
                    part = _fits(data, at + 1, 1) * (n - 128) if n > 128 else _fits(data, at + 1, n)
                    if not part or len(line) + len(part) > width:
                        raise ValueError("a run is damaged")
                    line += part
                    at += 2 if n > 128 else 1 + n
                planes.append(np.frombuffer(bytes(line), np.uint8))
            rows.append(np.stack(planes, axis=1))
        else:
            rows.append(np.frombuffer(_fits(data, at, width * 4), np.uint8).reshape(width, 4))
            at += width * 4
    raw = np.stack(rows)
    scale = np.where(raw[:, :, 3] > 0, np.ldexp(1.0, raw[:, :, 3].astype(np.int64) - 136), 0.0)[:, :, None]
    return np.clip(np.floor(np.power(raw[:, :, :3] * scale, 1 / 2.2) * 255 + 0.5), 0, 255).astype(np.uint8)


def pic(data: bytes) -> np.ndarray:
    """Softimage pictures: channels in packets, plain or with run lengths; alpha is dropped."""
    if data[:4] != b"\x53\x80\xf6\x34" or data[88:92] != b"PICT":
        raise ValueError("not a PIC")
    width, height = struct.unpack(">HH", _fits(data, 92, 4))
    _checked(width, height)
    at, packets, more = 104, [], 1
    while more:
        more, size, kind, channels = _fits(data, at, 4)
        if size != 8 or kind not in (0, 1, 2) or len(packets) == 10:
            raise ValueError("this PIC cannot be read")
        packets.append((kind, [c for c, bit in enumerate((128, 64, 32, 16)) if channels & bit]))
        at += 4
    out = np.zeros((height, width, 4), np.uint8)
    for y in range(height):
        for kind, planes in packets:
            step, x = len(planes), 0
            while x < width:
                if kind == 0:
                    n, run = width, 0
                else:
                    head = _fits(data, at, 1)[0]
                    at += 1
                    if kind == 1:
                        n, run = head, 1
                    elif head < 128:
                        n, run = head + 1, 0
                    elif head == 128:
                        n, run = struct.unpack(">H", _fits(data, at, 2))[0], 1
                        at += 2
                    else:
                        n, run = head - 127, 1
                if not n or x + n > width:
                    raise ValueError("a run is damaged")
                part = np.frombuffer(_fits(data, at, step if run else n * step), np.uint8).reshape(-1, step)
                out[y, x : x + n, planes] = part.T if not run else np.repeat(part, n, axis=0).T
                at += part.size
                x += n
    return out[:, :, :3]


READERS = {"bmp": bmp, "tga": tga, "wbmp": wbmp, "psd": psd, "hdr": hdr, "pic": pic}
