"""Pictures framed and flattened: numpy on decoded pixels (rows of BGR, BGRA or gray bytes), called from Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .geometry import GRAVITY
from .pixels import content_box

#: Radius in standard deviations at which the Gaussian of a blurred background is cut.
BLUR_SIGMA, BLUR_REACH = 30.0, 3


class NoContent(ValueError):
    """Trimming found nothing but background."""


@lru_cache(256)
def _lanczos_weights(n: int, m: int, lobes: int = 3) -> np.ndarray:
    """Row i holds the weights of the n old samples in new sample i; the kernel is as wide as the coarser grid asks for."""
    stretch = max(n / m, 1.0)
    centre = (np.arange(m) + 0.5) * n / m - 0.5
    x = (np.arange(n)[None, :] - centre[:, None]) / stretch
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return w / w.sum(1, keepdims=True)


def _separable(a: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    out = np.einsum("yh,hwc->ywc", rows, a.astype(np.float64), optimize=True)
    out = np.einsum("xw,ywc->yxc", columns, out, optimize=True)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def resized(a: np.ndarray, width: int, height: int) -> np.ndarray:
    if (width, height) == (a.shape[1], a.shape[0]):
        return a
    return _separable(a, _lanczos_weights(a.shape[0], height), _lanczos_weights(a.shape[1], width))


def blurred(a: np.ndarray, sigma: float = BLUR_SIGMA) -> np.ndarray:
    """Gaussian blur; beyond the border the border's pixels go on."""

    def weights(n: int) -> np.ndarray:
        reach = int(BLUR_REACH * sigma)
        kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
        at = np.clip(np.arange(n)[:, None] + np.arange(-reach, reach + 1)[None, :], 0, n - 1)
        out = np.zeros((n, n))
        np.add.at(out, (np.arange(n)[:, None], at), kernel / kernel.sum())
        return out

    return _separable(a, weights(a.shape[0]), weights(a.shape[1]))


def colour_of(text: str) -> tuple[int, int, int]:
    """Red, green and blue of six hex digits, with or without ``#``."""
    digits = text.lstrip("#")
    if len(digits) != 6:
        raise ValueError(f"not a colour: {text!r}")
    return tuple(bytes.fromhex(digits))


def flattened(a: np.ndarray, background: str = "#ffffff") -> np.ndarray:
    """Without alpha: seen over a background of one colour."""
    if a.shape[2] != 4:
        return a
    share = a[:, :, 3:].astype(np.float64) / 255
    under = np.array(colour_of(background)[::-1], np.float64)
    return np.floor(a[:, :, :3] * share + under * (1 - share) + 0.5).astype(np.uint8)


def with_channels(a: np.ndarray, channels: str | None, background: str = "#ffffff") -> np.ndarray:
    """``rgb``: three channels; ``grayscale``: one; None: as they are."""
    if channels is None:
        return a
    a = flattened(a, background)
    if channels == "rgb":
        return a if a.shape[2] == 3 else np.repeat(a, 3, axis=2)
    if channels != "grayscale":
        raise ValueError(f"not a set of channels: {channels!r}")
    if a.shape[2] == 1:
        return a
    luma = a.astype(np.float64) @ np.array([0.114, 0.587, 0.299])
    return np.floor(luma + 0.5).astype(np.uint8)[:, :, None]


def _bound(value: float) -> int:
    return max(1, round(value))


def framed(
    a: np.ndarray, width: int | None = None, height: int | None = None, mode: str = "crop", gravity: str = "center",
    fill: str = "color", colour: str = "#000000", margin: int = 0, trim: bool = False, tolerance: int = 8,
) -> np.ndarray:
    """The picture at a new size: in proportion (one side given), stretched, cropped to cover, or padded to fit.

    Padding fills with a colour, the edge's pixels, the picture mirrored at its edge, or the picture itself, blurred.
    """
    if trim:
        box = content_box(a, tolerance)
        if box is None:
            raise NoContent("nothing but background")
        a = a[box[1] : box[3], box[0] : box[2]]
    h, w = a.shape[:2]
    if width is None and height is None:
        return a
    if width is None or height is None:
        ratio = width / w if width is not None else height / h
        return resized(a, width or _bound(w * ratio), height or _bound(h * ratio))
    if (w, h) == (width, height) and not margin:
        return a
    if mode == "stretch":
        return resized(a, width, height)
    gx, gy = GRAVITY[gravity]
    if mode == "crop":
        ratio = max(width / w, height / h)
        big = resized(a, max(width, round(w * ratio)), max(height, round(h * ratio)))
        x, y = round((big.shape[1] - width) * gx), round((big.shape[0] - height) * gy)
        return big[y : y + height, x : x + width]
    if mode != "pad":
        raise ValueError(f"not a mode: {mode!r}")
    room_w, room_h = width - 2 * margin, height - 2 * margin
    ratio = min(room_w / w, room_h / h)
    small = resized(a, _bound(w * ratio), _bound(h * ratio))
    x, y = margin + round((room_w - small.shape[1]) * gx), margin + round((room_h - small.shape[0]) * gy)
    around = ((y, height - y - small.shape[0]), (x, width - x - small.shape[1]), (0, 0))
    if fill in ("edge", "reflect"):
        return np.pad(small, around, mode=fill)
    if fill == "blur":
        out = blurred(resized(a, width, height))
        out[y : y + small.shape[0], x : x + small.shape[1]] = small
        return out
    if fill != "color":
        raise ValueError(f"not a fill: {fill!r}")
    out = np.empty((height, width, 3), np.uint8)
    out[:] = colour_of(colour)[::-1]
    out[y : y + small.shape[0], x : x + small.shape[1]] = with_channels(flattened(small, colour), "rgb")
    return out
