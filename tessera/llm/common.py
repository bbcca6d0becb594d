"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.storage import Scratch, drop_written, fresh_path, release, remove, shared_dir, with_row_key, written

#: A word, in every operator here: a run of characters other than the ASCII space characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_CLASS + "+")).cast("long")


def unused(df: DataFrame, *names: str) -> list[str]:
    """For each name, one that no column of ``df`` has (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


__all__ = [
    "SPACE_CLASS", "WORD_CLASS", "Scratch", "components", "drop_written", "fresh_path", "n_words", "release", "remove", "shared_dir", "table", "text_or_empty",
    "unused", "with_row_key", "written",
]
