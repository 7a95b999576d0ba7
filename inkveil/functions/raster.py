"""Images by their pixels: a PNG's raster, and a hash of it that does not know how it was encoded."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format: the signature, and channels by the type of colour.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


class NotRead(ValueError):
    """The content is no PNG, or one of a kind that is not read here."""


def _chunks(content: bytes):
    at = len(SIGNATURE)
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        yield kind, content[at + 8 : at + 8 + size]
        at += 12 + size


def _unfiltered(lines: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Scan lines without their filters; a byte's neighbours are `step` before it and those above."""
    out = np.zeros_like(lines)
    above = np.zeros(lines.shape[1], np.uint8)
    for row, (kind, line) in enumerate(zip(kinds.tolist(), lines, strict=True)):
        if kind == 0:
            here = line
        elif kind == 1:  # each channel's running sum, modulo 256
            here = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            here = line + above
        elif kind in (3, 4):
            held, up = bytearray(line.tobytes()), above.tobytes()
            for i in range(len(held)):
                a, b = held[i - step] if i >= step else 0, up[i]
                if kind == 3:
                    near = (a + b) // 2
                else:
                    c = up[i - step] if i >= step else 0
                    to_a, to_b, to_c = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    near = a if to_a <= to_b and to_a <= to_c else b if to_b <= to_c else c
                held[i] = (held[i] + near) & 255
            here = np.frombuffer(bytes(held), np.uint8)
        else:
            raise NotRead(f"filter {kind}")
        out[row] = above = here
    return out


def decoded(content: bytes) -> np.ndarray:
    """A PNG of 8 or 16 bits a channel, not interlaced, as rows of RGB; transparency is dropped."""
    if not content.startswith(SIGNATURE):
        raise NotRead("no PNG")
    parts: dict[bytes, bytes] = {}
    for kind, body in _chunks(content):
        parts[kind] = parts.get(kind, b"") + body
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"][:13])
    if depth not in (8, 16) or interlaced or colour not in CHANNELS:
        raise NotRead(f"depth {depth}, colour {colour}, interlaced {interlaced}")
    step = CHANNELS[colour] * depth // 8
    raw = np.frombuffer(zlib.decompress(parts.get(b"IDAT", b"")), np.uint8).reshape(height, 1 + width * step)
    pixels = _unfiltered(raw[:, 1:], raw[:, 0], step).reshape(height, width, CHANNELS[colour], depth // 8)[:, :, :, 0]
    if colour == 3:
        return np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)[pixels[:, :, 0]]
    return np.repeat(pixels[:, :, :1], 3, axis=2) if colour in (0, 4) else pixels[:, :, :3]


def encoded(raster: np.ndarray, kind: int = 0, level: int = 6) -> bytes:
    """Rows of grey bytes as a PNG, with one filter for all lines; images can be stored so."""
    height, width = raster.shape
    body = bytearray()
    for y in range(height):
        body.append(kind)
        for x in range(width):
            a, b, c = (int(raster[y, x - 1]) if x else 0), (int(raster[y - 1, x]) if y else 0), (int(raster[y - 1, x - 1]) if x and y else 0)
            by_distance = min(((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c)))[2]
            body.append((int(raster[y, x]) - (0, a, b, (a + b) // 2, by_distance)[kind]) & 255)
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(body), level)) + chunk(b"IEND", b"")


def hash_of(content: bytes | None) -> str | None:
    """SHA-256 of the size and the RGB rows of a PNG; of other content, of its bytes."""
    if content is None:
        return None
    try:
        raster = decoded(content)
    except (NotRead, KeyError, ValueError, IndexError, struct.error, zlib.error):
        return hashlib.sha256(content).hexdigest()
    return hashlib.sha256(f"{raster.shape[1]}x{raster.shape[0]}:".encode() + np.ascontiguousarray(raster).tobytes()).hexdigest()


def pixel_hash(content: Column) -> Column:
    """`hash_of` a column of contents, in Arrow batches."""

    def of(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: hash_of(None if c is None else bytes(c)))

    return F.pandas_udf(of, "string")(content)
