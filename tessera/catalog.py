"""The media catalog: one row per media item, its sidecar as columns, and views that stand in for image
folders where only relational tables are at hand.

A bucket (folder) is a column, not a place; sidecar keys are typed columns, so a missing sidecar is a row of
nulls.  Every view is one projection, so filters and columns reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("box", T.ArrayType(T.IntegerType()))])
CLASSES = T.MapType(T.StringType(), T.ArrayType(BOX))
SIDECAR = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("license", T.StringType()),
        T.StructField("origin", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("phash", T.StringType()),
        T.StructField("classes", CLASSES),
        T.StructField("upscale", T.IntegerType()),
    ]
)
HIT_FIELDS = ["url", "engine", "query", "width", "height", "license", "source_domain", "title", "author", "date", "found_at", "quality_grade"]

#: File name suffixes of images and videos.
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".tif", ".webp"]
VIDEO_SUFFIXES = [".mp4", ".mkv", ".avi", ".mov", ".webm", ".flv", ".wmv", ".m4v"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as media items with sizes, metrics, provenance and detections."""
    d = F.col("doc_id")
    readable = d % 97 != 0
    blur = F.when(d % 11 != 0, (F.col("n_chars") % 1000) / 10.0)
    face = F.struct(((d % 100) / 100.0).alias("score"), F.array(F.lit(0), F.lit(0), F.lit(10), F.lit(10)).alias("box"))
    cat = F.struct(((d % 10) / 10.0).alias("score"), F.array(F.lit(1), F.lit(1), F.lit(5), F.lit(5)).alias("box"))
    none = F.lit(None).cast(T.ArrayType(BOX))
    classes = F.map_filter(
        F.map_from_arrays(
            F.array(F.lit("face"), F.lit("cat")),
            F.array(F.when(d % 3 != 0, F.array(face)).otherwise(F.array().cast(T.ArrayType(BOX))), F.when(d % 5 == 0, F.array(cat)).otherwise(none)),
        ),
        lambda k, v: v.isNotNull(),
    )
    return read(spark, sf_dir, "documents").select(
        d,
        F.concat(F.lit("b"), (d % 4).cast("string"), F.lit("/doc_"), d.cast("string"), F.lit(".jpg")).alias("path"),
        F.concat(F.lit("b"), (d % 4).cast("string")).alias("bucket"),
        F.concat(F.lit("doc_"), d.cast("string"), F.lit(".jpg")).alias("name"),
        F.when(readable, 256 + (d * 37) % 1793).cast("int").alias("width"),
        F.when(readable, 256 + (d * 53) % 1531).cast("int").alias("height"),
        F.element_at(F.array(F.lit("RGB"), F.lit("RGBA"), F.lit("L")), (d % 3 + 1).cast("int")).alias("mode"),
        F.col("n_chars").alias("file_size"),
        blur.alias("blur"),
        F.when(d % 29 != 0, F.concat(F.substring(F.md5("text"), 1, 15), F.lower(F.hex(d % 16)))).alias("phash"),
        F.when(d % 7 != 1, F.col("source")).alias("source"),
        F.element_at(F.array(F.lit(None).cast("string"), F.lit("CC0"), F.lit("cc-by"), F.lit("none"), F.lit("none")), (d % 5 + 1).cast("int")).alias("license"),
        (d % 7 == 0).alias("upscale"),
        F.when(d % 13 != 0, classes).alias("classes"),
        F.map_filter(F.create_map(F.lit("blur"), blur), lambda k, v: v.isNotNull()).alias("metrics"),
    )


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, twice, as search hits; the second engine knows fewer fields."""
    pages = read(spark, sf_dir, "pages")
    p = F.col("page_id")
    url = F.when(p % 17 == 0, F.lit("")).when(p % 23 == 0, F.lit(None)).otherwise(F.split_part("url", F.lit("?"), F.lit(1)))
    one = pages.select(
        url.alias("url"), F.lit("brave").alias("engine"), (200 + p * 7 % 1500).cast("string").alias("width"), F.when(p % 4 != 0, (200 + p * 11 % 1500).cast("string")).alias("height"),
        F.when(p % 3 == 0, F.concat(F.lit("t"), p.cast("string"))).alias("title"), F.when(p % 5 == 0, F.lit("someone")).alias("author"),
        F.element_at(F.array(F.lit("cc-by-4.0"), F.lit("cc-by-sa-4.0"), F.lit("CC0"), F.lit(""), F.lit(None).cast("string")), (p % 5 + 1).cast("int")).alias("license"), p.alias("ord"),
    )
    two = pages.select(
        url.alias("url"), F.lit("flickr").alias("engine"), F.lit("800").alias("width"), F.when(p % 2 == 0, F.lit("600")).alias("height"),
        F.when(p % 2 == 0, F.concat(F.lit("u"), p.cast("string"))).alias("title"), F.when(p % 4 == 0, F.lit("else")).alias("author"), F.lit("cc-by-2.0").alias("license"), (p + 1_000_000_000).alias("ord"),
    )
    return one.unionByName(two)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as raw detections of images of 640 x 480; ``ord`` is the detector's order (total)."""
    o = read(spark, sf_dir, "lineitem")
    x0 = (F.col("l_partkey") * 13 % 600).cast("int")
    y0 = (F.col("l_suppkey") * 17 % 440).cast("int")
    return o.select(
        F.col("l_orderkey").alias("image"), F.col("l_returnflag").alias("class"), (F.col("l_discount") * 8).alias("score"),
        x0.alias("x0"), y0.alias("y0"), (x0 + 8 + (F.col("l_linenumber") * 29) % 120).cast("int").alias("x1"), (y0 + 8 + (F.col("l_linenumber") * 31) % 100).cast("int").alias("y1"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_tax").alias("ord"),
    )


def as_requests(events: DataFrame) -> DataFrame:
    """Events as requests (domain, t, event_id, ok)."""
    return events.select(F.col("user_id").alias("domain"), F.col("ts").alias("t"), "event_id", (F.col("event_type") != "error").alias("ok"), "event_type")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_requests(read(spark, sf_dir, "events"))


def sign_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign bits of embeddings as two 32-bit halves."""
    bit = lambda lo, n: F.aggregate(
        F.slice("embedding", lo, n), F.lit(0).cast("long"), lambda s, x: s * 2 + F.when(x > 0, 1).otherwise(0).cast("long")
    )
    return read(spark, sf_dir, "embeddings").select("vec_id", bit(1, 32).alias("hi"), bit(33, 32).alias("lo"))
