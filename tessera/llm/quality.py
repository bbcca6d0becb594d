"""Quality rules: a threshold table compiled into one projection of ratios (no shuffle, no user function).

Every rule is ``low <= measure <= high``; measures are ratios of counts of the whole text.  The base
rules come first (too few words, too many words in repeated five-word windows); a document that passes
them is kept if all rows of the threshold table hold.

Defined results for odd input: a null text counts as an empty one (all counts 0, base fails); equal rows
give equal results; other columns are dropped by `measures` but for ``keep``; an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_CLASS, table

WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20

#: Frequent function words of four languages.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he are this or at from an".split(),
    "fr": "le la les de des du et en un une que est pour dans qui par sur au plus ne pas avec ce il".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "es": "el la los las de y en que a un una por con no para su se del al es lo como más o".split(),
}

#: name -> (lowest, highest) value that passes; None is no bound.
THRESHOLDS: dict[str, tuple[float | None, float | None]] = {
    "mean_word_chars": (2.0, 14.0),
    "symbol_ratio": (None, 0.10),
    "stop_word_ratio": (0.01, None),
    "duplicate_line_ratio": (None, 0.40),
    "word_line_ratio": (0.5, None),
}


def _counts(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Staged projections; each column is computed once because later ones use it more than once."""
    stops = {w for words in STOP_WORDS.values() for w in words}
    stops = sorted(stops | {w.capitalize() for w in stops} | {w.upper() for w in stops})
    quoted = ", ".join(f"'{w}'" for w in stops)
    shifted = ", ".join(["_ids", *(f"slice(_ids, {k + 1}, greatest(size(_ids) - {k}, 0))" for k in range(1, WINDOW))])
    kept = [F.col(f"`{c}`") for c in keep]
    out = df.select(*kept, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    out = out.select(
        *kept,
        F.array_remove(F.split("_text", SPACE_CLASS + "+"), "").alias("_words"),
        F.split("_text", "\n").alias("_all_lines"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.length("_text") - F.regexp_count("_text", F.lit(SPACE_CLASS))).cast("long").alias("word_chars"),
    )
    out = out.select(
        *kept, "n_symbols", "word_chars", "_words",
        F.size("_all_lines").cast("long").alias("n_lines"),
        F.filter("_all_lines", lambda line: line.rlike(WORD_CLASS)).alias("_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_ids"),
    )
    out = out.select(
        *kept, "n_symbols", "word_chars", "n_lines",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_word_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"size(filter(_words, w -> w IN ({quoted})))").cast("long").alias("n_stop_words"),
        F.expr(
            f"CASE WHEN size(_ids) >= {WINDOW} THEN transform(slice(arrays_zip({shifted}), 1, size(_ids) - {WINDOW - 1}), w -> xxhash64(w)) "
            "ELSE CAST(array() AS array<bigint>) END"
        ).alias("_hashes"),
    )
    # Only a text with a repeated window is sorted; window hashes have 64 bits and are compared within one text.
    out = out.withColumn(
        "_sorted",
        F.expr(
            "CASE WHEN size(array_distinct(_hashes)) < size(_hashes) THEN sort_array(transform(_hashes, (h, i) -> struct(h AS h, i AS i))) "
            "ELSE CAST(array() AS array<struct<h:bigint,i:int>>) END"
        ),
    )
    out = out.withColumn(
        "_at",
        F.expr(
            "sort_array(transform(filter(_sorted, (x, k) -> (k > 0 AND get(_sorted, k - 1).h = x.h) OR coalesce(get(_sorted, k + 1).h = x.h, false)), x -> x.i))"
        ),
    )
    return out.withColumn(
        "n_repeat_words",
        F.expr(
            f"CASE WHEN size(_at) = 0 THEN 0L ELSE {WINDOW}L + aggregate(_at, struct(_at[0] AS last, 0L AS n), "
            f"(s, p) -> struct(p AS last, s.n + CAST(least({WINDOW}, p - s.last) AS bigint) AS n), s -> s.n) END"
        ),
    ).drop("_hashes", "_sorted", "_at")


def _ratio(top: str, bottom: str) -> Column:
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1))


def measures(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Counts and ratios of every text beside the columns ``keep`` (default: all others)."""
    keep = [c for c in df.columns if c != text] if keep is None else keep
    return _counts(df, text, keep).withColumns(
        {
            "mean_word_chars": _ratio("word_chars", "n_words"),
            "symbol_ratio": _ratio("n_symbols", "n_words"),
            "stop_word_ratio": (F.col("n_stop_words") + 1) / F.greatest(F.col("n_words"), F.lit(1)),  # one is added: short texts may have none
            "duplicate_line_ratio": _ratio("n_dup_lines", "n_word_lines"),
            "word_line_ratio": _ratio("n_word_lines", "n_lines"),
        }
    )


def compile_thresholds(thresholds: dict[str, tuple[float | None, float | None]]) -> Column:
    """The whole table as one boolean expression."""
    held = F.lit(True)
    for name, (low, high) in thresholds.items():
        if low is not None:
            held = held & (F.col(name) >= low)
        if high is not None:
            held = held & (F.col(name) <= high)
    return held


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def judge(df: DataFrame, text: str = "text", keep: list[str] | None = None, thresholds=None) -> DataFrame:
    """`measures` with ``base_failed`` and ``kept``."""
    held = compile_thresholds(THRESHOLDS if thresholds is None else thresholds)
    return measures(df, text, keep).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & held)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, keep=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
