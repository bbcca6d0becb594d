"""Files as results: items with their sidecars copied or moved, and result files of search hits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import HIT_FIELDS
from ..operators.hits import richest_hits
from ..operators.storage import written
from .files import InputError, _fs, exists, read_hits


def place_items(items: DataFrame, folder: str, move: bool = False) -> DataFrame:
    """Copies or moves the files in ``path`` to ``folder`` under ``name``, with a sidecar where there is one.

    Returns ``path, target, sidecar, error`` once all is done.  A file appears under its name only when it is
    whole, and a repeated task writes the same again; of rows with one name the smallest path is placed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def put(source: str, target: str) -> bool:
            store, at = fs.FileSystem.from_uri(source)
            there, to = fs.FileSystem.from_uri(target)
            kind = store.get_file_info(at).type
            if kind != fs.FileType.File:  # moved by an earlier try of this task, or never there
                return move and there.get_file_info(to).type == fs.FileType.File
            there.create_dir(to.rsplit("/", 1)[0], recursive=True)
            with store.open_input_stream(at) as a, there.open_output_stream(f"{to}.part") as b:
                while part := a.read(1 << 20):
                    b.write(part)
            there.move(f"{to}.part", to)
            if move:
                store.delete_file(at)
            return True

        for batch in batches:
            rows = []
            for path, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target, side, error = f"{folder}/{name}", False, None
                try:
                    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
                    uri = "file:///" + uri.split(":", 1)[1].lstrip("/") if uri.startswith("file:") else uri
                    if not put(uri, target):
                        raise FileNotFoundError(path)
                    side = put(f"{uri}.json", f"{target}.json")
                except OSError as e:
                    error = str(e)
                rows.append((path, target, side, error))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.bool_(), pa.string()))], ["path", "target", "sidecar", "error"]) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.string(), pa.string(), pa.bool_(), pa.string())], ["path", "target", "sidecar", "error"])

    if "://" not in folder:
        raise InputError("the folder has to be an address, as file:///...")
    one = items.groupBy("name").agg(F.min("path").alias("path"))
    return written(one.select("path", "name").mapInArrow(run, "path string, target string, sidecar boolean, error string"), "placed")


def write_hits(spark: SparkSession, new: DataFrame, path: str) -> int:
    """Merges hits into the JSON-lines folder ``path``, one record an address, the richest; returns their number.

    What is there comes first.  The merged records are written beside it and take its place when they are whole.
    """
    fields = [c for c in HIT_FIELDS if c in new.columns]
    numbered = lambda df, first: df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in HIT_FIELDS], (F.monotonically_increasing_id() + F.lit(first)).alias("ord"))
    both = numbered(new.select(*fields), 1 << 62)
    if exists(spark, path):
        both = numbered(read_hits(spark, path), 0).union(both)
    both = written(both, "hits")
    kept = richest_hits(both.where("url <> ''"), HIT_FIELDS).select(*HIT_FIELDS)
    kept.write.mode("overwrite").json(f"{path}.new")
    where, fs = _fs(spark, path)
    fresh, _ = _fs(spark, f"{path}.new")
    fs.delete(where, True)
    if not fs.rename(fresh, where):
        raise InputError(f"{path}.new could not take the place of {path}")
    return read_hits(spark, path).count()
