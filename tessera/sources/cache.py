"""Embeddings that were computed before, as a Parquet table by model and item version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import exists


def version_key(model: str) -> Column:
    """Digest of the model and of what identifies an item's version (path, length, modification time)."""
    return F.sha2(F.concat_ws("\u001f", F.lit(model), "path", F.col("length").cast("string"), F.col("modificationTime").cast("string")), 256)


def split(items: DataFrame, folder: str, model: str) -> tuple[DataFrame | None, DataFrame]:
    """(cached rows with embedding or None, items still to compute)."""
    spark: SparkSession = items.sparkSession
    keyed = items.withColumn("key", version_key(model))
    if not exists(spark, folder):
        return None, keyed
    cached = spark.read.parquet(folder).dropDuplicates(["key"])
    return keyed.join(cached, "key"), keyed.join(cached.select("key"), "key", "left_anti")


def append(computed: DataFrame, folder: str) -> None:
    computed.select("key", "embedding").write.mode("append").parquet(folder)
