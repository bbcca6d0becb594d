"""Measures and transforms of pixels: numpy over Arrow batches of Spark's decoded images (rows of BGR or BGRA bytes)."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_array(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def gray(a: np.ndarray) -> np.ndarray:
    """Luma of BGR(A) or gray pixels, rounded."""
    if a.shape[2] == 1:
        return a[:, :, 0].astype(np.float64)
    b, g, r = (a[:, :, k].astype(np.float64) for k in range(3))
    return np.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5)


def blur_of(a: np.ndarray) -> float:
    """Variance of the 3 x 3 Laplacian, borders mirrored without the edge; two digits."""
    p = np.pad(gray(a), 1, mode="reflect") if min(a.shape[:2]) > 1 else np.pad(gray(a), 1, mode="edge")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    return round(float(lap.var()), 2)


def _resize(a: np.ndarray, size: int) -> np.ndarray:
    """Area means, after bilinear enlargement of images smaller than the target."""
    h, w = a.shape
    ys, xs = (np.linspace(0, n, size + 1) for n in (h, w))
    total = np.pad(a, ((1, 0), (1, 0))).cumsum(0).cumsum(1)

    def at(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        y0, x0 = np.minimum(y.astype(int), h - 1), np.minimum(x.astype(int), w - 1)
        fy, fx = (y - y0)[:, None], (x - x0)[None, :]
        top = total[np.ix_(y0, x0)] * (1 - fx) + total[np.ix_(y0, x0 + 1)] * fx
        low = total[np.ix_(y0 + 1, x0)] * (1 - fx) + total[np.ix_(y0 + 1, x0 + 1)] * fx
        return top * (1 - fy) + low * fy

    s = at(ys, xs)
    return (s[1:, 1:] - s[:-1, 1:] - s[1:, :-1] + s[:-1, :-1]) / ((h / size) * (w / size))


def _dct(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))


_DCT32 = _dct(32)


def phash_of(a: np.ndarray) -> str:
    """64 bits: which of the 8 x 8 lowest frequencies of the 32 x 32 image exceed their median."""
    low = (_DCT32 @ _resize(gray(a), 32) @ _DCT32.T)[:8, :8]
    bits = (low > np.median(low)).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def content_box(a: np.ndarray, tolerance: int = 8) -> tuple[int, int, int, int] | None:
    """Box of what is seen: alpha above the tolerance, or, without alpha, farther than that from the corners' median (cut to whole numbers)."""
    h, w, channels = a.shape
    if channels == 4:
        off = a[:, :, 3]
    else:
        corners = a[:: max(h - 1, 1), :: max(w - 1, 1)].reshape(-1, channels)
        off = np.abs(a.astype(int) - np.median(corners, axis=0).astype(int)).max(axis=2)
    places = np.argwhere(off > tolerance)
    if not len(places):
        return None
    (top, left), (bottom, right) = places.min(axis=0), places.max(axis=0)
    return int(left), int(top), int(right) + 1, int(bottom) + 1


def flipped(a: np.ndarray, axes: str) -> np.ndarray:
    return a[:: -1 if "Y" in axes else 1, :: -1 if "X" in axes else 1]


def encode_png(a: np.ndarray, level: int = 0) -> bytes:
    rgb = a if a.shape[2] == 1 else a[:, :, [2, 1, 0, 3][: a.shape[2]]]
    raw = np.concatenate([np.zeros((a.shape[0], 1), np.uint8), rgb.reshape(a.shape[0], -1)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, {1: 0, 3: 2, 4: 6}[a.shape[2]], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


def png_is_compressed(content: bytes) -> bool | None:
    """Whether the first image chunk was compressed with more than the fastest level; None if it is no PNG."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at = 8
    while at + 12 <= len(content):
        (n,) = struct.unpack(">I", content[at : at + 4])
        if content[at + 4 : at + 8] == b"IDAT":
            return n >= 2 and content[at + 9] >> 6 > 0
        at += 12 + n
    return None


def _over_images(kind: T.DataType, f):
    """A function of the columns data, width, height, nChannels; null where the image could not be decoded."""

    @F.pandas_udf(kind)
    def run(data: pd.Series, width: pd.Series, height: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([f(to_array(d, w, h, c)) if d is not None and w > 0 else None for d, w, h, c in zip(data, width, height, channels)], dtype=object)

    return run


blur = _over_images(T.DoubleType(), blur_of)
phash = _over_images(T.StringType(), phash_of)
trim_box = _over_images(T.ArrayType(T.IntegerType()), lambda a: list(b) if (b := content_box(a)) else None)


def flip(axes: str):
    return _over_images(T.BinaryType(), lambda a: encode_png(flipped(a, axes)))


@F.pandas_udf(T.BooleanType())
def png_compressed(content: pd.Series) -> pd.Series:
    return content.map(png_is_compressed)
