"""Detections: ranked lists per image and class, counts, crops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import clamp_crop, expand_box


def top_instances(raw: DataFrame, most: int = 1) -> DataFrame:
    """(image, class, k, score, box): the ``most`` best of each image and class; equal scores keep the detector's order."""
    w = Window.partitionBy("image", "class").orderBy(F.desc("score"), "ord")
    out = raw.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    return out.select("image", F.lower("class").alias("class"), "k", "score", F.array(*[F.col(c).cast("int") for c in ("x0", "y0", "x1", "y1")]).alias("box"))


def class_counts(media: DataFrame) -> DataFrame:
    """Images with at least one detection of each class."""
    return media.select(F.explode(F.map_entries("classes")).alias("e")).groupBy(F.col("e.key").alias("class")).agg(F.count_if(F.size("e.value") > 0).alias("images"))


def crops(raw: DataFrame, width: int, height: int, margin: float = 0.0, square: bool = False, min_score: float = 0.0, skip_partial: bool = False) -> DataFrame:
    """One crop a detection with at least ``min_score``, its pixels and its name.

    A class with one such detection in an image gets a name without a number; numbers count emitted crops
    in order, and crops that are skipped as partial still count for whether there are several.
    """
    w, h = F.lit(width), F.lit(height)
    box = expand_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), margin, square)
    names = ("ex0", "ey0", "ex1", "ey1")
    out = raw.where(F.col("score") >= min_score).withColumns(dict(zip(names, box)))
    out = out.withColumn("several", F.count("*").over(Window.partitionBy("image", "class")) > 1)
    if skip_partial:
        out = out.where("ex0 >= 0 AND ey0 >= 0").where((F.col("ex1") <= w) & (F.col("ey1") <= h))
    out = out.withColumns(dict(zip(("cx0", "cy0", "cx1", "cy1"), clamp_crop(tuple(F.col(n) for n in names), w, h, square))))
    out = out.where("cx1 > cx0 AND cy1 > cy0")
    number = F.row_number().over(Window.partitionBy("image", "class").orderBy(F.desc("score"), "ord")) - 1
    stem = F.concat_ws("_", F.col("image").cast("string"), F.lower("class"))
    return out.withColumn("number", number).withColumn(
        "crop", F.when(F.col("several"), F.format_string("%s_%02d.jpg", stem, "number")).otherwise(F.concat(stem, F.lit(".jpg")))
    )
