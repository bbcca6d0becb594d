"""Folders of media, sidecars, result files and address lists as DataFrames.

Listing and reading go through Spark's own readers, so any store it can read will do.
"""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import HIT_FIELDS, IMAGE_SUFFIXES, SIDECAR
from ..functions.urls import source_of, suffix


class InputError(ValueError):
    """Bad arguments, or nothing to read."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _fs(spark, path)
    return fs.exists(where)


def resolve_dirs(spark: SparkSession, spec: str, base: str) -> list[str]:
    """Comma-separated folder names under ``base``; patterns become the matching folders in order; no folder twice.

    A plain name that does not exist is kept: whether that is an error is the caller's matter.
    """
    out: list[str] = []
    for part in (p.strip() for p in spec.split(",")):
        if not part:
            continue
        if any(c in part for c in "*?"):
            where, fs = _fs(spark, base)
            names = sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory())
            out += [f"{base}/{n}" for n in names if fnmatch.fnmatchcase(n, part)]
        else:
            out.append(f"{base}/{part}")
    return list(dict.fromkeys(out))


def scan(spark: SparkSession, dirs: list[str], suffixes: list[str] = IMAGE_SUFFIXES, recursive: bool = False, content: bool = False, strict: bool = True) -> DataFrame:
    """(path, bucket, name, length, modificationTime[, content]) of the files with the suffixes.

    Strict: a missing folder is an error.  Lenient: it is left out, and only no folder at all is one.
    """
    there = [d for d in dirs if exists(spark, d)]
    if strict and len(there) < len(dirs):
        raise InputError(f"no such folder: {', '.join(d for d in dirs if d not in there)}")
    if not there:
        raise InputError("no folder to read")
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    files = reader.load(there).where(suffix(F.col("path")).isin(suffixes))
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    columns = ["path", folder.alias("bucket"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", "modificationTime"]
    return files.select(*columns, *(["content"] if content else []))


def sidecars(spark: SparkSession, dirs: list[str]) -> DataFrame:
    """(path of the media file, sidecar columns) of every ``<file>.json``."""
    raw = spark.read.schema(SIDECAR).option("multiLine", True).option("pathGlobFilter", "*.json").json(dirs)
    return raw.select(F.regexp_replace("_metadata.file_path", r"\.json$", "").alias("path"), *SIDECAR.names)


def _same_path(c: Column) -> Column:
    return F.regexp_replace(c, "^file:/+", "/")


def with_sidecars(media: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Every media row; a missing sidecar is a row of nulls."""
    side = sidecar.withColumn("_key", _same_path(F.col("path"))).drop("path")
    return media.withColumn("_key", _same_path(F.col("path"))).join(side, "_key", "left").drop("_key")


def json_lines(lines: DataFrame, schema: str, line: str = "line") -> DataFrame:
    """The fields of one JSON object a row in place of ``line``; blank and malformed lines are left out."""
    others = [c for c in lines.columns if c != line]
    bad = "_bad_line"
    parsed = lines.where(F.trim(line) != "").withColumn("_r", F.from_json(line, f"{schema}, {bad} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}))
    return parsed.where(F.col("_r").isNotNull() & F.col(f"_r.{bad}").isNull()).select(*others, "_r.*").drop(bad)


def url_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """``url, source, license`` in place of ``line``; comments and blank lines are left out."""
    others = [c for c in lines.columns if c != line]
    urls = lines.select(*others, F.trim(line).alias("url")).where((F.col("url") != "") & ~F.startswith("url", F.lit("#")))
    return urls.withColumns({"source": source_of(F.col("url")), "license": F.lit("none")})


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Search hits of a JSON-lines file."""
    return json_lines(spark.read.text(path).withColumnRenamed("value", "line"), ", ".join(f"{f} string" for f in HIT_FIELDS))


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """(url, source, license) of a list with one address a line."""
    return url_lines(spark.read.text(path).withColumnRenamed("value", "line"))


def png_size(content: Column) -> tuple[Column, Column]:
    """Width and height from a PNG's header, without decoding; null for other files."""
    is_png = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    number = lambda at: F.when(is_png, F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int"))
    return number(17), number(21)
