"""Boxes, crops and frames as column expressions; rounding is half to even, casts cut toward zero."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAVITY = {"center": (0.5, 0.5), "top": (0.5, 0.0), "bottom": (0.5, 1.0), "left": (0.0, 0.5), "right": (1.0, 0.5), "top-left": (0.0, 0.0), "top-right": (1.0, 0.0), "bottom-left": (0.0, 1.0), "bottom-right": (1.0, 1.0)}


def expand_box(x0: Column, y0: Column, x1: Column, y1: Column, margin: float, square: bool) -> tuple[Column, ...]:
    """A box made square about its centre, then widened by a share of its longer side."""
    w, h = x1 - x0, y1 - y0
    if square:
        side, cx, cy = F.greatest(w, h), (x0 + x1) / 2, (y0 + y1) / 2
        x0, y0, x1, y1 = cx - side / 2, cy - side / 2, cx + side / 2, cy + side / 2
        w = h = side
    more = F.greatest(w, h) * margin
    return x0 - more, y0 - more, x1 + more, y1 + more


def clamp_crop(box: tuple[Column, ...], width: Column, height: Column, square: bool) -> tuple[Column, ...]:
    """Whole pixels inside the image; a square crop stays square and is moved inside."""
    x0, y0, x1, y1 = box
    zero = F.lit(0)
    if not square:
        return F.greatest(zero, x0.cast("int")), F.greatest(zero, y0.cast("int")), F.least(width, x1.cast("int")), F.least(height, y1.cast("int"))
    side = F.least(F.bround(x1 - x0).cast("int"), width, height)
    left = F.greatest(zero, F.least(x0.cast("int"), width - side))
    top = F.greatest(zero, F.least(y0.cast("int"), height - side))
    return left, top, left + side, top + side


def scale_classes(classes: Column, factor: float) -> Column:
    """All boxes times a factor, cut toward zero."""
    scaled = lambda d: F.struct(d["score"].alias("score"), F.transform(d["box"], lambda c: (c * F.lit(factor)).cast("int")).alias("box"))
    return F.transform_values(classes, lambda k, v: F.transform(v, scaled))


def shift_classes(classes: Column, left: Column, top: Column, width: Column, height: Column) -> Column:
    """Boxes relative to a crop; starts are held at 0 and ends at the crop's size."""
    zero = F.lit(0)
    moved = lambda d: F.struct(
        d["score"].alias("score"),
        F.array(F.greatest(zero, d["box"][0] - left), F.greatest(zero, d["box"][1] - top), F.least(width, d["box"][2] - left), F.least(height, d["box"][3] - top)).alias("box"),
    )
    return F.transform_values(classes, lambda k, v: F.transform(v, moved))


def gravity_offset(canvas: Column, size: Column, share: float) -> Column:
    return F.bround((canvas - size) * F.lit(share)).cast("int")


def frame_geometry(width: Column, height: Column, to_width: int, to_height: int, mode: str, gravity: str = "center", margin: int = 0) -> dict[str, Column]:
    """Size after scaling and place on the canvas: stretch, crop (covers it) or pad (fits in it)."""
    gx, gy = GRAVITY[gravity]
    if mode == "stretch":
        return {"scaled_w": F.lit(to_width), "scaled_h": F.lit(to_height), "off_x": F.lit(0), "off_y": F.lit(0)}
    inner_w, inner_h = (to_width - 2 * margin, to_height - 2 * margin) if mode == "pad" else (to_width, to_height)
    ratio = (F.greatest if mode == "crop" else F.least)(F.lit(float(inner_w)) / width, F.lit(float(inner_h)) / height)
    w = F.greatest(F.lit(1), F.bround(width * ratio).cast("int"))
    h = F.greatest(F.lit(1), F.bround(height * ratio).cast("int"))
    if mode == "crop":
        w, h = F.greatest(w, F.lit(to_width)), F.greatest(h, F.lit(to_height))
    return {"scaled_w": w, "scaled_h": h, "off_x": gravity_offset(F.lit(to_width), w, gx), "off_y": gravity_offset(F.lit(to_height), h, gy)}


def resolve_margin(value: str | int | None, width: int, height: int) -> int:
    """``None``, whole pixels, or percent of the shorter side (half to even); raises where it leaves no room."""
    if value is None:
        return 0
    found = re.fullmatch(r"(\d+)|(\d+(?:\.\d*)?|\.\d+)%", str(value).strip(), re.ASCII)
    if not found:
        raise ValueError(f"not a margin: {value!r}")
    shorter = min(width, height)
    margin = int(found[1]) if found[1] else round(float(found[2]) / 100 * shorter)
    if 2 * margin >= shorter:
        raise ValueError(f"margin {value!r} leaves no room in {width} x {height}")
    return margin


def hex_channel(colour: Column, k: int) -> Column:
    """Channel 0, 1 or 2 of six hex digits with or without ``#``; null if it is none."""
    plain = F.regexp_extract(F.lower(colour), "^#?([0-9a-f]{6})$", 1)
    return F.when(plain != "", F.conv(F.substring(plain, 2 * k + 1, 2), 16, 10).cast("int"))


def tile_grid(width: Column, height: Column, tile: int = 512, pad: int = 32) -> Column:
    """Array of tiles with the padded window each is read from."""
    xs = F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0)), F.lit(tile))
    ys = F.sequence(F.lit(0), F.greatest(height - 1, F.lit(0)), F.lit(tile))
    one = lambda x, y: F.struct(
        x.alias("x0"), y.alias("y0"), F.least(x + tile, width).alias("x1"), F.least(y + tile, height).alias("y1"),
        F.greatest(x - pad, F.lit(0)).alias("in_x0"), F.greatest(y - pad, F.lit(0)).alias("in_y0"), F.least(x + tile + pad, width).alias("in_x1"), F.least(y + tile + pad, height).alias("in_y1"),
    )
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: one(x, y))))
