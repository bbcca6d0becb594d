"""Kind, size and channels of pictures from their first bytes, without decoding."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

Header = tuple[str, int, int, int]


def _png(b: bytes) -> Header:
    width, height, _, colour = struct.unpack(">IIBB", b[16:26])
    # Colour types 0 gray, 2 colour, 3 palette, 4 gray with alpha, 6 colour with alpha.
    return "png", width, height, {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}[colour]


def _gif(b: bytes) -> Header:
    return "gif", *struct.unpack("<HH", b[6:10]), 3


def _bmp(b: bytes) -> Header:
    (size,) = struct.unpack("<I", b[14:18])
    if size == 12:
        width, height, _, bits = struct.unpack("<HHHH", b[18:26])
    else:
        width, height, _, bits = struct.unpack("<iiHH", b[18:30])
    return "bmp", width, abs(height), 4 if bits == 32 else 3


def _jpeg(b: bytes) -> Header | None:
    at = 2
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            return None
        kind = b[at + 1]
        if kind == 0xFF or 0xD0 <= kind <= 0xD8 or kind == 1:  # fill bytes and markers without a body
            at += 1 if kind == 0xFF else 2
            continue
        (n,) = struct.unpack(">H", b[at + 2 : at + 4])
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame's start
            height, width, channels = struct.unpack(">HHB", b[at + 5 : at + 10])
            return "jpeg", width, height, channels
        at += 2 + n
    return None


def _webp(b: bytes) -> Header | None:
    kind = b[12:16]
    if kind == b"VP8X":
        flags, width, height = b[20], int.from_bytes(b[24:27], "little"), int.from_bytes(b[27:30], "little")
        return "webp", width + 1, height + 1, 4 if flags & 0x10 else 3
    if kind == b"VP8L":
        bits = int.from_bytes(b[21:25], "little")
        return "webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, 4 if bits >> 28 & 1 else 3
    if kind == b"VP8 ":
        width, height = struct.unpack("<HH", b[26:30])
        return "webp", width & 0x3FFF, height & 0x3FFF, 3
    return None


def _tiff(b: bytes) -> Header | None:
    order = "<" if b[:2] == b"II" else ">"
    (at,) = struct.unpack(order + "I", b[4:8])
    (n,) = struct.unpack(order + "H", b[at : at + 2])
    found = {}
    for k in range(n):
        entry = b[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind = struct.unpack(order + "HH", entry[:4])
        if tag in (256, 257, 277):  # width, height, samples a pixel
            found[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), entry[8 : 10 if kind == 3 else 12])[0]
    return ("tiff", found[256], found[257], found.get(277, 1)) if 256 in found and 257 in found else None


READERS = [(b"\x89PNG\r\n\x1a\n", _png), (b"GIF87a", _gif), (b"GIF89a", _gif), (b"BM", _bmp), (b"\xff\xd8", _jpeg), (b"II*\0", _tiff), (b"MM\0*", _tiff)]


def header_of(content: bytes) -> Header | None:
    """(kind, width, height, channels); None for what is no picture known here or is cut short."""
    try:
        for start, read in READERS:
            if content.startswith(start):
                return read(content)
        if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
            return _webp(content)
    except (struct.error, IndexError, KeyError):
        pass
    return None


@F.pandas_udf(T.StructType([T.StructField("kind", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("width", "height", "channels")]]))
def image_header(content: pd.Series) -> pd.DataFrame:
    """`header_of` for a column of file contents; nulls where there is none."""
    rows = [(header_of(c) if c is not None else None) or (None,) * 4 for c in content]
    return pd.DataFrame(rows, columns=["kind", "width", "height", "channels"]).astype({"width": "Int32", "height": "Int32", "channels": "Int32"})
