"""The staged filter: one expression names the first test that a media row fails."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Criteria:
    """What to ask for; what is left unset is not tested."""

    min_side: int | None = None
    max_side: int | None = None
    min_width: int | None = None
    max_width: int | None = None
    min_height: int | None = None
    max_height: int | None = None
    min_metric: list[tuple[str, float]] = field(default_factory=list)
    max_metric: list[tuple[str, float]] = field(default_factory=list)
    max_detect: list[tuple[str, float]] = field(default_factory=list)
    min_detect: list[tuple[str, float]] = field(default_factory=list)
    source: list[str] = field(default_factory=list)
    license: list[str] = field(default_factory=list)


def reject_reason(c: Criteria) -> Column:
    """Null for rows to keep.  Unreadable items (null sizes) pass the size tests: a null comparison fails no test."""
    w, h = F.col("width"), F.col("height")
    tests: list[tuple[Column, str]] = []
    longer = F.when(w.isNotNull() & h.isNotNull(), F.greatest(w, h))
    for low, high, value, name in ((c.min_side, c.max_side, longer, "side"), (c.min_width, c.max_width, w, "width"), (c.min_height, c.max_height, h, "height")):
        if low is not None:
            tests.append((value < low, f"{name} too small"))
        if high is not None:
            tests.append((value > high, f"{name} too large"))
    metric = lambda name: F.try_element_at("metrics", F.lit(name))
    for name, limit in c.min_metric:
        tests += [(metric(name).isNull(), f"missing '{name}' metric data"), (metric(name) < limit, f"{name} too low")]
    for name, limit in c.max_metric:
        tests += [(metric(name).isNull(), f"missing '{name}' metric data"), (metric(name) > limit, f"{name} too high")]
    if c.max_detect or c.min_detect:
        tests.append((F.col("classes").isNull(), "missing detection data"))
    score = lambda name: F.try_element_at(F.try_element_at("classes", F.lit(name.lower())), F.lit(1))["score"]
    tests += [(score(name) >= limit, f"'{name}' detected") for name, limit in c.max_detect]
    for name, limit in c.min_detect:
        tests += [(score(name).isNull(), f"'{name}' not detected"), (score(name) < limit, f"'{name}' below threshold")]
    for column, allowed in (("source", c.source), ("license", c.license)):
        if allowed:
            tests += [(F.col(column).isNull(), f"missing {column} data"), (~F.lower(column).isin([a.lower() for a in allowed]), f"{column} not allowed")]
    if not tests:
        return F.lit(None).cast("string")
    out = F.when(*[tests[0][0], F.lit(tests[0][1])])
    for test, reason in tests[1:]:
        out = out.when(test, F.lit(reason))
    return out


def select(media: DataFrame, criteria: Criteria) -> DataFrame:
    """All rows with ``reject_reason``; filter on null for the kept ones."""
    return media.withColumn("reject_reason", reject_reason(criteria))


def not_at_destination(kept: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows to write: names that are not there yet; of equal names in several buckets the first path wins."""
    first = kept.groupBy("name").agg(F.min("path").alias("path"))
    return kept.join(first.join(existing.select("name"), "name", "left_anti").select("path"), "path", "left_semi")


def restorable(duplicates: DataFrame, origin: DataFrame) -> DataFrame:
    """Items of a duplicates folder that can go back: names that the origin does not have."""
    return duplicates.join(origin.select("name"), "name", "left_anti")


def pending_metrics(media: DataFrame, wanted: list[str], force: bool = False) -> DataFrame:
    """Items with the metrics that are still to be computed (none of them done yet if forced)."""
    have = F.array().cast("array<string>") if force else F.coalesce(F.map_keys("metrics"), F.array().cast("array<string>"))
    todo = F.array_except(F.array(*[F.lit(w) for w in wanted]), have)
    return media.withColumn("todo", todo).where(F.size("todo") > 0)


def annotate(media: DataFrame, overwrite: bool = False, **values: str | None) -> DataFrame:
    """Fills (or overwrites) provenance columns; ``changed`` tells whether a row got anything new."""
    out, changed = media, F.lit(False)
    for name, value in values.items():
        if value is None:
            continue
        changed = changed | (F.lit(True) if overwrite else F.col(name).isNull())
        out = out.withColumn(f"_{name}", F.lit(value) if overwrite else F.coalesce(name, F.lit(value)))
    out = out.withColumn("changed", changed)
    for name, value in values.items():
        if value is not None:
            out = out.drop(name).withColumnRenamed(f"_{name}", name)
    return out


def rename(media: DataFrame, prefix: str, digits: int | None = None) -> DataFrame:
    """Numbers from 1 in the order of bucket and path, without one task sorting all rows.

    Rows are range-partitioned; counts per partition (one row each) give each its first number.
    """
    from pyspark.sql import Window

    parts = media.repartitionByRange("bucket", "path").withColumn("_pid", F.spark_partition_id()).checkpoint()
    counts = parts.groupBy("_pid").count()
    starts = counts.select("_pid", (F.coalesce(F.sum("count").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_start"))
    number = F.row_number().over(Window.partitionBy("_pid").orderBy("bucket", "path")) + F.col("_start")
    width = digits if digits is not None else len(str(parts.count()))
    numbered = parts.join(F.broadcast(starts), "_pid").withColumn("number", number.cast("long")).drop("_pid", "_start")
    suffix = F.regexp_extract("name", r"(\.[^./]+)$", 1)
    return numbered.withColumn("new_name", F.concat(F.lit(prefix), F.format_string(f"%0{width}d", "number"), suffix))


def merge_metrics(old: Column, new: Column) -> Column:
    """Map union in which new keys win."""
    return F.map_concat(F.map_filter(F.coalesce(old, F.create_map().cast("map<string,double>")), lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)


#: What each pixel operation leaves out of the sidecar it passes on.
DROPPED_BY = {"augment": ("metrics", "classes"), "extract_faces": ("metrics", "classes"), "extract_frames": ("metrics", "classes"), "frame": ("metrics", "classes"), "extract_classes": ("metrics",), "format": ("metrics",), "upscale": ("metrics",), "select": (), "cluster": (), "dedup": (), "rename": ()}


def propagate(media: DataFrame, operation: str) -> DataFrame:
    """The columns a result of the operation keeps; the rest are null."""
    return media.withColumns({c: F.lit(None).cast(media.schema[c].dataType) for c in DROPPED_BY[operation] if c in media.columns})
