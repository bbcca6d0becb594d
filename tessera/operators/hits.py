"""Search hits: one record an address, filters before a fetch, query lists, summaries, request control."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Suffixes that are never fetched, and hosts whose media need a video tool.
UNSUPPORTED = [".djvu", ".svg", ".gif"]
BREAKER = 5


def richest_hits(hits: DataFrame, fields: list[str]) -> DataFrame:
    """One record an address: the one with most non-null fields, then the earliest; ``first_ord`` is where the address came first.

    ``max_by`` aggregates before the shuffle, so a hot address sends one row a task.
    """
    filled = sum([F.when(F.col(f).isNotNull(), 1).otherwise(0) for f in fields], F.lit(0))
    row = F.struct(*fields, "ord")
    return (
        hits.where((F.col("url").isNotNull()) & (F.col("url") != ""))
        .groupBy("url")
        .agg(F.max_by(row, F.struct(filled.alias("n"), (-F.col("ord")).alias("o"))).alias("r"), F.min("ord").alias("first_ord"))
        .select("url", *[F.col(f"r.{f}").alias(f) for f in fields if f != "url"], F.col("r.ord").alias("ord"), "first_ord")
    )


def fetchable(hits: DataFrame, min_size: int | None = None, licenses: list[str] | None = None) -> DataFrame:
    """Hits to fetch with ``unsupported``; sizes that cannot be read keep a hit, missing licences drop it if some are asked for."""
    w, h = F.expr("try_cast(width AS int)"), F.expr("try_cast(height AS int)")
    out = hits
    if min_size is not None:
        out = out.where(~F.coalesce((w.isNotNull() & h.isNotNull()) & (F.greatest(w, h) < min_size), F.lit(False)))
    if licenses:
        allowed = F.lit(False)
        for prefix in licenses:
            allowed = allowed | F.col("license").startswith(prefix)
        out = out.where(F.coalesce(allowed, F.lit(False)))
    out = out.where(F.col("url").isNotNull() & (F.col("url") != ""))
    path = F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))
    return out.withColumn("unsupported", F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(UNSUPPORTED))


def query_matrix(terms: DataFrame, suffixes: DataFrame, suffix_only: bool = False) -> DataFrame:
    """(ord, query): every term bare, then each term with each non-empty suffix, term by term.

    The suffixes are listed in one array (a search's own settings), not joined.
    """
    listed = suffixes.where(F.trim("suffix") != "").agg(F.sort_array(F.collect_list(F.struct("s", "suffix"))).alias("list"))
    pairs = terms.join(F.broadcast(listed)).select("t", "term", F.explode("list").alias("x")).select(F.lit(1).alias("part"), "t", F.col("x.s").alias("s"), F.concat_ws(" ", "term", "x.suffix").alias("query"))
    bare = terms.select(F.lit(0).alias("part"), "t", F.lit(0).alias("s"), F.col("term").alias("query"))
    return pairs if suffix_only else bare.unionByName(pairs)


def tripped(requests: DataFrame, limit: int = BREAKER) -> DataFrame:
    """(domain, tripped_at): when a domain first had ``limit`` failures in a row; a later success does not help.

    Failures are numbered within runs that end at successes (gaps and islands).
    """
    by_time = Window.partitionBy("domain").orderBy("t", "event_id")
    runs = requests.withColumn("run", F.sum(F.col("ok").cast("int")).over(by_time))
    failed = runs.where("NOT ok").withColumn("k", F.row_number().over(Window.partitionBy("domain", "run").orderBy("t", "event_id")))
    return failed.where(F.col("k") >= limit).groupBy("domain").agg(F.min("t").alias("tripped_at"))
