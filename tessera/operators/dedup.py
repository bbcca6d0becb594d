"""Near-duplicate media by perceptual hash: an exact Hamming join, components, one winner each."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components

THRESHOLD = 8
#: Slices of a hash for up to so many hashes, and beyond.
MANY_HASHES, MORE_SLICES, FEW_SLICES = 1_000_000, 5, 3


def halves(phash: str) -> list[Column]:
    """A 16-digit hex hash as two non-negative longs (a 64-bit value would overflow when its top bit is set)."""
    return [F.conv(F.substring(phash, 1, 8), 16, 10).cast("long").alias("hi"), F.conv(F.substring(phash, 9, 8), 16, 10).cast("long").alias("lo")]


def hamming(a: str = "", b: str = "_2") -> Column:
    return F.bit_count(F.col(f"hi{a}").bitwiseXOR(F.col(f"hi{b}"))) + F.bit_count(F.col(f"lo{a}").bitwiseXOR(F.col(f"lo{b}")))


def _slices(parts: int) -> list[tuple[int, int, Column]]:
    """(number, width, value) of even slices of the 64 bits."""
    out, at = [], 0
    for k in range(parts):
        width = 64 // parts + (1 if k < 64 % parts else 0)
        value = F.lit(0).cast("long")
        if at < 32:  # bits of the upper half
            n = min(width, 32 - at)
            value = F.shiftleft(F.shiftright("hi", 32 - at - n).bitwiseAND((1 << n) - 1), width - n)
        if at + width > 32:
            n = min(width, at + width - 32)
            value = value + F.shiftright("lo", 64 - at - width).bitwiseAND((1 << n) - 1)
        out.append((k, width, value))
        at += width
    return out


def _ball(width: int, radius: int) -> list[int]:
    """All masks of up to ``radius`` bits."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def n_slices(threshold: int, n_hashes: int) -> int:
    """Fewer, longer slices probe more values each and meet fewer strangers, which pays for many hashes."""
    return max(1, min(threshold + 1, FEW_SLICES if n_hashes > MANY_HASHES else MORE_SLICES))


def hamming_pairs(hashes: DataFrame, threshold: int = THRESHOLD, slices: int | None = None) -> DataFrame:
    """Pairs (a, b, distance) of distinct hashes (id, hi, lo), a < b, within the threshold; equal ones are merged before.

    Of ``slices`` slices one differs in at most ``threshold // slices`` bits, so an equi-join of all slices with all
    values that close to them finds every pair, whatever the number of slices.
    """
    slices = n_slices(threshold, hashes.count()) if slices is None else slices
    cut = _slices(slices)
    held = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, _, v in cut])

    def around(k: int, width: int, value: Column) -> Column:
        masks = F.array(*[F.lit(m).cast("long") for m in _ball(width, threshold // slices)])
        return F.transform(masks, lambda m: F.struct(F.lit(k).alias("k"), value.bitwiseXOR(m).alias("v")))

    near = [around(*x) for x in cut]
    probes = hashes.withColumn("slice", F.explode(F.flatten(F.array(*near))))
    index = hashes.withColumn("slice", F.explode(held)).select(F.col("id").alias("id_2"), F.col("hi").alias("hi_2"), F.col("lo").alias("lo_2"), "slice")
    met = probes.join(index, "slice").where((F.col("id") < F.col("id_2")) & (hamming() <= threshold))
    return met.select(F.col("id").alias("a"), F.col("id_2").alias("b"), hamming().cast("int").alias("distance")).distinct()


def duplicate_groups(media: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Media rows of groups of two or more with ``grp`` (the smallest path).  Readable items with a hash take part."""
    rows = media.where(F.col("phash").isNotNull() & F.col("width").isNotNull())
    distinct = rows.groupBy("phash").agg(F.count("*").alias("n"), F.min("path").alias("p")).select(F.col("phash").alias("id"), *halves("phash"), "n", "p").checkpoint()
    links = hamming_pairs(distinct.select("id", "hi", "lo"), threshold)
    labels = components(links)
    named = distinct.join(labels, F.col("id") == F.col("node"), "left").withColumn("label", F.coalesce("label", "id"))
    groups = named.groupBy("label").agg(F.sum("n").alias("members"), F.min("p").alias("grp")).where("members > 1")
    chosen = named.select("id", "label").join(groups, "label").select(F.col("id").alias("phash"), "grp", "members").checkpoint()
    return rows.join(chosen, "phash")


def winners(groups: DataFrame, prefer_upscaled: bool = False) -> DataFrame:
    """Adds ``winner``: the best by preference, resolution, file size, sharpness; ties go to the smaller path.

    ``max_by`` aggregates before the shuffle, so a group may hold any share of all rows.
    """
    preferred = F.coalesce(F.col("upscale"), F.lit(False)) if prefer_upscaled else ~F.coalesce(F.col("upscale"), F.lit(False))
    rank = F.struct(preferred.cast("int").alias("p"), (F.col("width").cast("long") * F.col("height")).alias("area"), F.col("file_size").alias("s"), F.coalesce("blur", F.lit(0.0)).alias("b"))
    ranked = groups.withColumn("_rank", rank)
    top = ranked.groupBy("grp").agg(F.max("_rank").alias("_top")).checkpoint()
    best = ranked.join(top, "grp").where(F.col("_rank") == F.col("_top")).groupBy("grp").agg(F.min("path").alias("best")).checkpoint()
    return ranked.join(best, "grp").withColumn("winner", F.col("path") == F.col("best")).drop("_rank", "best")


def summary(won: DataFrame, hashed: int) -> DataFrame:
    """Counts of groups, kept and lost items, and the mode."""
    out = won.agg(F.count_distinct("grp").alias("groups"), F.count_if("winner").alias("kept"), F.count_if(~F.col("winner")).alias("losers"))
    return out.withColumn("mode", F.when((F.lit(hashed) < 2) | (F.col("groups") == 0), "noop").otherwise("dedup"))
