"""A training corpus from ``documents``: five stages, each a function of (spark, docs, sf_dir).

Each stage works on all that its predecessor kept.  All but the last return the columns of ``documents``;
``n_chars`` follows the text where a stage changes it.

Defined results for odd input: null texts count as empty ones (no toxic word, no line, no near-copy, size 0, one
sequence piece); rows with equal or null ids are rows of their own (stages tell rows apart by a row key, not by
``doc_id``), and of equal rows one stays; other columns of ``docs``, whatever their names, pass through all stages but the
last; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_duplicates, mixing, near_duplicates, packing, toxicity
from tessera.llm.common import n_words, table, unused, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go."""
    model = toxicity.fit_on_tables(docs, table(spark, sf_dir, "labels"))
    (name,) = unused(docs, "toxicity")
    return toxicity.score(docs, model, column=name).where(F.col(name) < toxicity.THRESHOLD).drop(name)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of equal or nearly equal lines the first stays; documents that lose all their words go."""
    cut = line_duplicates.without_duplicate_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays."""
    return near_duplicates.without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    (size,) = unused(docs, "mix_size")
    sized = docs.withColumn(size, n_words(F.col("text")))
    copies = mixing.added_names(sized)[2]
    mixed = mixing.mix(sized, "source", size, ["doc_id"])
    return mixed.withColumn(copies, F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces with their sequence and place."""
    return packing.pack_documents(docs, with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("near_dedup", keep_one_of_each_class),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has no toxicity model, alignment or tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
