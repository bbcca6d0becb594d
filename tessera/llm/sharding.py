"""Contiguous balanced shards by global byte-size prefix sums.

The rows are range-partitioned by a total order and written once with their partition number.  Totals per
partition (one row each) give every partition its start in the global prefix sum; within a partition a
running sum completes it.  A row goes to the shard in whose equal share of all bytes its middle byte lies,
so shards are contiguous in the order and differ from the target by less than one row at either cut.

Only tables with one row per partition or per shard are broadcast: their size is the number of partitions
or shards, whatever the input holds.  DataFrame functions only.

Defined results for odd input: null texts have no bytes (their size is the overhead alone); rows are ordered
by the order column (null first), then by a hash of the text, then by a salt, so that many rows with one
order value spread over partitions; equal rows are interchangeable; columns of the input keep their names and values (an
added column whose name is taken gets underscores in front); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, text_or_empty, unused, written

N_SHARDS = 24
OVERHEAD = 8
#: Rows that one range partition holds at most, about.
ROWS_PER_PARTITION = 200_000


def assign_shards(df: DataFrame, size: str, order: list[str], n_shards: int = N_SHARDS) -> DataFrame:
    """Adds ``shard`` (int, from 0) and ``slot`` (long, place within the shard, from 0); see `added_names`.

    ``size`` names a positive long column, ``order`` the columns of the order (ties are broken by a salt).
    The row order within equal ``order`` values is arbitrary but fixed once written.
    """
    spark, names, out_names = df.sparkSession, df.columns, added_names(df)
    # The input's columns are fields of one struct from here on, so that no name can clash.
    keys = [f"key_{i}" for i in range(len(order))]
    base = df.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{size}`").alias("size"), *[F.col(f"`{c}`").alias(k) for c, k in zip(order, keys)],
        F.monotonically_increasing_id().alias("salt"),
    )
    with Scratch(spark) as s:
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8, -(-df.count() // ROWS_PER_PARTITION))
        placed = s.written(base.repartitionByRange(n, *keys, "salt").withColumn("pid", F.spark_partition_id()), "shard")
        by_order = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
        totals = placed.groupBy("pid").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        starts = totals.select(
            "pid",
            F.coalesce(F.sum("bytes").over(by_order), F.lit(0)).alias("start"),
            F.coalesce(F.sum("rows").over(by_order), F.lit(0)).alias("first"),
            F.sum("bytes").over(Window.partitionBy(F.lit(0))).alias("total"),
        )
        within = Window.partitionBy("pid").orderBy(*keys, "salt")
        before = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
        summed = placed.withColumns({"before": before, "rank": F.row_number().over(within) - 1})
        middle = F.col("before") + F.col("start") + F.col("size") / 2
        shard = F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.greatest(F.col("total"), F.lit(1)))).cast("int")
        ranked = summed.join(F.broadcast(starts), "pid").select("row", shard.alias("shard"), (F.col("rank") + F.col("first")).cast("long").alias("rank"))
        ranked = written(ranked, "shard-ranked")
    firsts = ranked.groupBy("shard").agg(F.min("rank").alias("first"))  # one row per shard
    out = ranked.join(F.broadcast(firsts), "shard")
    slot = (F.col("rank") - F.col("first")).cast("long")
    return out.select(*[F.col("row")[c].alias(c) for c in names], F.col("shard").alias(out_names[0]), slot.alias(out_names[1]))


def added_names(df: DataFrame) -> list[str]:
    """The names of the columns that `assign_shards` adds."""
    return unused(df, "shard", "slot")


def op8_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_or_empty()
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32")
    )
    return assign_shards(docs, "size", ["doc_id", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
