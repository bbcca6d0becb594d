"""Search hits and requests as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import HIT_FIELDS


def hit_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New JSON-lines files of a folder as they come; lines that are no hit are dropped."""
    schema = ", ".join(f"{f} string" for f in HIT_FIELDS)
    lines = spark.readStream.text(folder)
    parsed = lines.withColumn("r", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.where("r._bad IS NULL AND r.url IS NOT NULL AND r.url <> ''").select("r.*").drop("_bad")


def first_hits(hits: DataFrame, delay: str | None = None) -> DataFrame:
    """One hit an address.  With ``delay``, state older than the watermark on ``found_at`` is forgotten."""
    if delay is None:
        return hits.dropDuplicates(["url"])
    timed = hits.withColumn("found_at", F.to_timestamp("found_at")).withWatermark("found_at", delay)
    return timed.dropDuplicatesWithinWatermark(["url"])


def failure_rates(requests: DataFrame, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Failures by domain and time window of a stream (domain, t, ok), final once the watermark has passed."""
    return requests.withWatermark("t", delay).groupBy(F.window("t", window), "domain").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("failed"))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what is there to a Parquet table and stops; a later call goes on from there."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
