"""Portable bitmaps, graymaps and pixmaps, as text (P1..P3) or bytes (P4..P6)."""

from __future__ import annotations

import re

import numpy as np

SIDE_LIMIT = 65536


def read(data: bytes) -> tuple[np.ndarray, int, int]:
    """RGB raster (rows x columns x 3), width and height."""
    kind = int(data[1:2])
    if data[:1] != b"P" or not 1 <= kind <= 6:
        raise ValueError("not a portable map")
    tokens, at = [], 2
    while len(tokens) < (2 if kind in (1, 4) else 3):
        m = re.compile(rb"(?:\s|#[^\n]*\n)*([0-9]+)").match(data, at)
        if not m:
            raise ValueError("the header is cut short")
        tokens.append(int(m[1]))
        at = m.end()
    width, height = tokens[:2]
    top = tokens[2] if len(tokens) > 2 else 1
    if not 0 < width <= SIDE_LIMIT or not 0 < height <= SIDE_LIMIT or not 0 < top <= 65535:
        raise ValueError("bad size or depth")
    planes = 3 if kind in (3, 6) else 1
    n = width * height * planes
    body = re.sub(rb"#[^\n]*", b" ", data[at:]) if kind <= 3 else data[at + 1 :]
    if kind == 1:  # digits need not be apart
        values = np.frombuffer(bytes(body.translate(None, b" \t\r\n\v\f")[:n]), np.uint8).astype(np.int64) - 48
    elif kind <= 3:
        values = np.array(body.split()[:n], np.int64)
    elif kind == 4:
        row = (width + 7) // 8
        packed = np.frombuffer(body[: row * height].ljust(row * height, b"\0"), np.uint8).reshape(height, row)
        values = np.unpackbits(packed, axis=1)[:, :width].astype(np.int64).ravel()
    else:
        values = np.frombuffer(body[: n * (1 + (top > 255))], ">u2" if top > 255 else np.uint8).astype(np.int64)
    values = np.pad(values[:n], (0, n - len(values[:n])))
    if kind in (1, 4):
        values = 1 - np.minimum(values, 1)  # a set bit is black
    raster = np.minimum(values * 255 // top, 255).astype(np.uint8).reshape(height, width, planes)
    return np.repeat(raster, 3, axis=2) if planes == 1 else raster, width, height
