"""Aggregates over a catalog: validation, cluster ranks, status counts, greedy key frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def validate(media: DataFrame, square: bool = False) -> DataFrame:
    """One row: counts and whether all sizes and modes agree (and are square, if asked), and nothing failed."""
    failed = F.col("width").isNull()
    out = media.agg(
        F.count("*").alias("total"),
        F.count_if(failed).alias("failed"),
        F.count_distinct(F.when(~failed, F.struct("width", "height"))).alias("dims"),
        F.count_distinct(F.when(~failed, F.col("mode"))).alias("modes"),
        F.count_if(F.col("width") != F.col("height")).alias("non_square"),
    )
    passed = (F.col("dims") <= 1) & (F.col("modes") <= 1) & (F.col("failed") == 0)
    return out.withColumn("passed", passed & (F.col("non_square") == 0) if square else passed)


def cluster_ranks(labelled: DataFrame, top: int | None = None) -> DataFrame:
    """(label, n, rank, folder): clusters by size, then label; noise (-1) and clusters beyond ``top`` go to noise."""
    sizes = labelled.groupBy("label").agg(F.count("*").alias("n"))
    ranked = sizes.where("label >= 0").withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("n"), "label")) - 1).cast("int"))
    noise = sizes.where("label < 0").withColumn("rank", F.lit(None).cast("int"))
    within = F.col("rank").isNotNull() & (F.lit(True) if top is None else F.col("rank") < top)
    return ranked.unionByName(noise).withColumn("folder", F.when(within, F.format_string("%03d", "rank")).otherwise("noise"))


def greedy_frames(frames: DataFrame, interval: float) -> DataFrame:
    """Per video the first frame, then each at least ``interval`` after the last one kept.

    A fold over the sorted distinct times of a video (one pass, no Python); a video's times are one row.
    """
    times = frames.groupBy("video").agg(F.sort_array(F.collect_set("t")).alias("ts"))
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<double>").alias("kept"))
    keep = lambda s, t: s["last"].isNull() | (t - s["last"] >= interval)
    step = lambda s, t: F.when(keep(s, t), F.struct(t.alias("last"), F.array_append(s["kept"], t).alias("kept"))).otherwise(s)
    return times.select("video", F.explode(F.aggregate("ts", start, step)["kept"]).alias("t"))


def l2_normalized(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def augmented(media: DataFrame, flips: tuple[str, ...] = ("X", "Y", "XY"), copy: bool = True) -> DataFrame:
    """One row for the original and each flip, with the new name."""
    stem, suffix = F.regexp_replace("name", r"\.[^./]+$", ""), F.regexp_extract("name", r"(\.[^./]+)$", 1)
    variants = [F.struct(F.lit("").alias("flip"), F.col("name").alias("new_name"))] if copy else []
    variants += [F.struct(F.lit(f).alias("flip"), F.concat(stem, F.lit(f"_flip{f}"), suffix).alias("new_name")) for f in flips]
    if not variants or not flips:
        raise ValueError("ask for at least one flip")
    return media.withColumn("v", F.explode(F.array(*variants))).select("path", "v.flip", "v.new_name")


def reformatted(media: DataFrame, suffix: str) -> DataFrame:
    """New names after a change of format, with ``clash``: other items get the same name."""
    new = F.concat(F.regexp_replace("name", r"\.[^./]+$", ""), F.lit(suffix))
    named = media.withColumn("new_name", new)
    shared = named.groupBy("new_name").agg(F.count("*").alias("n")).where("n > 1").select("new_name", F.lit(True).alias("clash"))
    return named.join(shared, "new_name", "left").withColumn("clash", F.coalesce("clash", F.lit(False)))
