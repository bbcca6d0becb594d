"""Plans for downloads: which task asks which host, how fast, and when to give up.

The plan is data: a row an address with its host's policy and its lane.  A host has as many lanes as it
allows connections, and a task takes whole lanes, so no lock is shared between executors.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import content_key, host, needs_video_tool

#: Host, connections, seconds between requests; all other hosts have the default.
POLICIES = [
    ("upload.wikimedia.org", 2, 0.7),
    ("live.staticflickr.com", 6, 0.0),
    ("inaturalist-open-data.s3.amazonaws.com", 4, 0.2),
    ("static.inaturalist.org", 4, 0.2),
]
DEFAULT_CONNECTIONS, DEFAULT_DELAY = 8, 0.0
ATTEMPTS = 3


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICIES, "host string, connections int, delay double")


def download_plan(urls: DataFrame) -> DataFrame:
    """Addresses (url) with host, lane, delay of the lane, file stem, and whether a video tool takes them.

    The policy table is a constant of four rows, so it is broadcast.
    """
    known = urls.withColumn("host", F.coalesce(host(F.col("url")), F.lit(""))).join(F.broadcast(policies(urls.sparkSession)), "host", "left")
    connections = F.coalesce("connections", F.lit(DEFAULT_CONNECTIONS))
    return known.select(
        "url", "host",
        F.pmod(F.xxhash64("url"), connections).cast("int").alias("lane"),
        (F.coalesce("delay", F.lit(DEFAULT_DELAY)) * connections).alias("lane_delay"),
        content_key(F.col("url")).alias("stem"),
        needs_video_tool(F.col("url")).alias("video"),
    )


def pending(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """Addresses whose file (by stem) is not there yet."""
    return plan.join(existing.select("stem"), "stem", "left_anti")


def by_lane(plan: DataFrame, tasks: int) -> DataFrame:
    """Lanes dealt over tasks; a lane's addresses follow each other in one task."""
    return plan.repartition(tasks, "host", "lane").sortWithinPartitions("host", "lane", "url")


def wait_before_retry(attempt: int, retry_after: str | None, most: float | None) -> float | None:
    """Seconds to wait after a refused attempt (from 0); None gives up."""
    if attempt + 1 >= ATTEMPTS:
        return None
    try:
        wait = float(retry_after) if retry_after is not None else 2.0**attempt + random.random()
    except ValueError:
        wait = 2.0**attempt + random.random()
    return wait if most is None or wait <= most else None
