"""PNG masks in numpy and zlib: 8-bit grey, RGB and RGBA, not interlaced."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def write_png(image: np.ndarray) -> bytes:
    """``(H, W)`` grey or ``(H, W, 3)`` RGB bytes; rows unfiltered."""
    height, width = image.shape[:2]
    kind = 0 if image.ndim == 2 else 2
    rows = np.ascontiguousarray(image.astype(np.uint8)).reshape(height, -1)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """``(H, W, channels)`` bytes."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, head = 8, b"", None
    while at < len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        content = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", content)
        elif name == b"IDAT":
            body += content
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise ValueError("only 8-bit, not interlaced PNG is read")
    width, height, n = head[0], head[1], _CHANNELS[head[3]]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width * n), np.uint8)
    above = np.zeros(width * n, np.uint8)
    for y in range(height):
        above = out[y] = _unfilter(raw[y, 0], raw[y, 1:], above, n)
    return out.reshape(height, width, n)


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, n), axis=0, dtype=np.uint8).ravel()
    out = np.zeros(len(row), np.int32)
    up = above.astype(np.int32)
    for i in range(len(row)):
        a = out[i - n] if i >= n else 0
        if kind == 3:
            guess = (a + up[i]) // 2
        else:
            c = up[i - n] if i >= n else 0
            p = a + up[i] - c
            pa, pb, pc = abs(p - a), abs(p - up[i]), abs(p - c)
            guess = a if pa <= pb and pa <= pc else up[i] if pb <= pc else c
        out[i] = (int(row[i]) + guess) & 255
    return out.astype(np.uint8)


def encode_fbc(footprint: np.ndarray, boundary: np.ndarray, contact: np.ndarray) -> bytes:
    """The three channels as 0/255."""
    return write_png(np.stack([footprint, boundary, contact], axis=2).astype(bool) * np.uint8(255))


def empty_fbc(height: int, width: int) -> bytes:
    return write_png(np.zeros((height, width, 3), np.uint8))


def decode_fbc(data: bytes, channels: int = 3) -> np.ndarray:
    """``(H, W, channels)`` 0/1; a grey mask is repeated."""
    image = read_png(data)
    if image.shape[2] == 1:
        image = np.repeat(image, 3, axis=2)
    return (image[:, :, :channels] > 127).astype(np.uint8)


def encode_mask(mask: np.ndarray) -> bytes:
    return write_png(mask.astype(bool) * np.uint8(255))
