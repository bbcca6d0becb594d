"""Mixing sources to target weights by hash-threshold histograms.

Every row has a fixed 60-bit hash of its key.  A source whose target is ``e`` whole passes over it plus a remainder
takes every row ``e`` times and, once more, the rows whose hash lies below the source's threshold.  The
threshold comes from histograms of sizes by source and hash bucket: the bucket in which the cumulative size
crosses the remainder is refined by the next bits, and no other, until the hash is used up or the
remainder is met.  Rows of one key (ids that repeat or are null) are refined the same way by a hash of a row
key.  Only the first histogram reads all rows; each later one reads the boundary buckets, which the one before
wrote.  Thresholds of growing budgets are nested, so a larger target keeps every row of a
smaller one.  Nothing is sorted; rows are only hashed, summed and filtered.  DataFrame functions only.

Sources are joined to their targets by broadcast while there are at most ``MAX_BROADCAST_SOURCES``; beyond,
by source and salt, so that a source with a third of all rows spreads over ``SALTS`` tasks.  Targets are found
from one row a source in one task.

Defined results for odd input: null is a source of its own, last in the order; null texts have size 0 and
are taken with any threshold they fall under; rows with equal keys are taken by their row key; a source of
size 0 has target 0; no row is taken more than ``repeat`` times; columns of the input keep their names and values,
and an added column whose name is taken gets underscores in front; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, n_words, table, unused, with_row_key, written

WEIGHTS = (5, 2, 1)
BUDGET_PERCENT = 150
MAX_REPEAT = 2
#: Bits of the hash that one round of the histogram resolves, and rounds.
BITS, ROUNDS = 12, 5
MAX_BROADCAST_SOURCES = 10_000
SALTS = 64


def source_targets(sizes: DataFrame, weights=WEIGHTS, percent: int = BUDGET_PERCENT, repeat: int = MAX_REPEAT) -> DataFrame:
    """``src, source_size`` -> also ``target`` (double).

    Targets are ``min(repeat * size, level * weight)`` for the one level at which they sum to the budget:
    sources sorted by the level at which they reach their cap are capped up to the point where the rest can
    share what is left.  This is the fixed point of sharing the excess of capped sources again and again.
    One row per source and array of partial sums; no loop.
    """
    rank = F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())) - 1
    choice = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    all_rows = Window.partitionBy(F.lit(0))
    by_level = Window.orderBy("cap_level", F.col("src").asc_nulls_last())
    s = sizes.withColumn("weight", choice).withColumn("cap", F.lit(float(repeat)) * F.col("source_size"))
    s = s.withColumn("cap_level", F.col("cap") / F.col("weight")).withColumn("budget", F.sum("source_size").over(all_rows) * percent / 100.0)
    upto = by_level.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("caps_before", F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
    s = s.withColumn("weights_from", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    # The level if exactly the sources before this one are capped; it holds at the first source it does not cap.
    s = s.withColumn("level_here", (F.col("budget") - F.col("caps_before")) / F.col("weights_from"))
    level = F.min(F.when(F.col("level_here") < F.col("cap_level"), F.struct("cap_level", "level_here"))).over(all_rows)["level_here"]
    s = s.withColumn("level", level)
    return s.select("src", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def _joined(rows: DataFrame, per_source: DataFrame, n_sources: int, salt: Column) -> DataFrame:
    """Every row with what ``per_source`` (column src) says of its source."""
    right, at = per_source.withColumnRenamed("src", "other_src"), F.pmod(salt, F.lit(SALTS)).cast("int")
    same = F.col("src").eqNullSafe(F.col("other_src"))
    if n_sources <= MAX_BROADCAST_SOURCES:
        return rows.join(F.broadcast(right), same).drop("other_src")
    right = right.withColumn("other_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("own_salt", at).join(right, same & (F.col("own_salt") == F.col("other_salt"))).drop("other_src", "other_salt", "own_salt")


def _thresholds(s: Scratch, rows: DataFrame, targets: DataFrame, n_sources: int) -> DataFrame:
    """``src, epochs, hash_at, tie_at``: once more the rows with a smaller hash, or with that hash and a smaller tie.

    Each round sums sizes of the boundary bucket's sub-buckets: at most 2**BITS rows a source.
    """
    zero = F.lit(0).cast("long")
    state = targets.withColumn("epochs", F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("long"))
    state = state.select("src", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"), zero.alias("prefix"))
    inside, hash_at = rows, None
    for column in ("hash", "tie"):
        if column == "tie":
            hash_at = state.select(F.col("src").alias("hash_src"), F.col("prefix").alias("hash_at"))
            refined = not state.where("rest > 0 AND n > 1").isEmpty()
            if not refined:
                break
            state = state.withColumn("prefix", zero)
        for k in range(ROUNDS):
            shift = BITS * (ROUNDS - k - 1)
            buckets = inside.groupBy("src", F.shiftright(column, shift).alias("bucket")).agg(F.sum("size").alias("tokens"), F.count_if(F.col("size") > 0).alias("n"))
            run = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
            summed = buckets.withColumn("before", F.coalesce(F.sum("tokens").over(run), F.lit(0))).withColumnRenamed("src", "bucket_src")
            met = state.select("src", "epochs", "rest", "prefix").join(summed, F.col("src").eqNullSafe(F.col("bucket_src")), "left")
            # The boundary bucket is the last that starts at or before the remainder and holds anything.
            fits = F.coalesce((F.col("before") <= F.col("rest")) & (F.col("tokens") > 0) & (F.col("rest") > 0), F.lit(False))
            best = met.groupBy("src", "epochs", "rest", "prefix").agg(F.max(F.when(fits, F.struct("bucket", "before", "tokens", "n"))).alias("best"))
            state = s.written(best.select(
                "src", "epochs",
                (F.col("rest") - F.coalesce("best.before", zero)).alias("rest"),
                F.coalesce("best.bucket", F.shiftleft("prefix", BITS)).alias("prefix"),
                F.coalesce("best.tokens", zero).alias("tokens"),
                F.coalesce("best.n", zero).alias("n"),
            ), f"mix-{column}-{k}")
            open_ = state.where("rest > 0 AND n > 0").select("src", F.col("prefix").alias("at"))
            inside = _joined(inside, open_, n_sources, F.col("tie")).where(F.shiftright(column, shift) == F.col("at")).drop("at")
            inside = s.written(inside, "mix-boundary")
    # What is left in the boundary is taken if that comes nearer to the target than leaving it.
    taken = (F.col("tokens") > 0) & (F.col("rest") * 2 >= F.col("tokens"))
    tie_at = F.col("prefix") + F.when(taken, 1).otherwise(0) if refined else F.when(taken, F.lit(1 << (BITS * ROUNDS))).otherwise(0)
    return state.join(hash_at, F.col("src").eqNullSafe(F.col("hash_src"))).select("src", "epochs", "hash_at", tie_at.cast("long").alias("tie_at"))


def row_hash(key: list[str]) -> Column:
    """60 bits of the key's digest."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in key])), 1, BITS * ROUNDS // 4), 16, 10).cast("long")


def mix(df: DataFrame, source: str, size: str, key: list[str], weights=WEIGHTS, percent: int = BUDGET_PERCENT, repeat: int = MAX_REPEAT) -> DataFrame:
    """Adds ``source_size, target, copies`` (see `added_names`): how often the mix takes the row.  ``key``: columns that identify a row."""
    names = df.columns
    out_names = added_names(df)
    with Scratch(df.sparkSession) as s:
        (row_key,) = unused(df, "row_key")
        keyed = with_row_key(df, row_key, "mix-rows")
        tie = F.shiftrightunsigned(F.xxhash64(F.lit(7), F.col(row_key)), 64 - BITS * ROUNDS)
        # From here on the input's columns are fields of one struct, so that no name can clash.
        base = keyed.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{source}`").alias("src"), F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)).alias("size"), row_hash(key).alias("hash"), tie.alias("tie"))
        slim = s.written(base.drop("row"), "mix-slim")
        sizes = slim.groupBy("src").agg(F.sum("size").alias("source_size"))
        targets = s.written(source_targets(sizes, weights, percent, repeat), "mix-targets")
        n_sources = targets.count()
        chosen = _thresholds(s, slim, targets, n_sources).withColumnRenamed("src", "chosen_src")
        plan = targets.join(chosen, F.col("src").eqNullSafe(F.col("chosen_src"))).drop("chosen_src")
        plan = written(plan, "mix-plan")
    below = (F.col("hash") < F.col("hash_at")) | ((F.col("hash") == F.col("hash_at")) & (F.col("tie") < F.col("tie_at")))
    copies = (F.col("epochs") + F.when(below, 1).otherwise(0)).cast("long")
    joined = _joined(base, plan, n_sources, F.col("tie"))
    return joined.select(*[F.col("row")[c].alias(c) for c in names], *[c.alias(n) for c, n in zip((F.col("source_size"), F.col("target"), copies), out_names)])


def added_names(df: DataFrame) -> list[str]:
    """The names of the columns that `mix` adds."""
    return unused(df, "source_size", "target", "copies")


def op10_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mix(docs, "source", "size", ["doc_id"]).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
