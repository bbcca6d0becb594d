"""Where tables that cut lineage go, and how they go away again."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is made and named there, but only if driver and executors are one
    process; on a cluster a folder of one machine would lose tables, so that raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        local = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, local, True)
        base = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Lets ``checkpoint()`` write to `shared_dir`."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(spark))


_made: list[str] = []


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/tessera/{tag}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives the loss of executors, and fixes row order-dependent ids."""
    path = fresh_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row_key(df: DataFrame, name: str, tag: str = "keyed") -> DataFrame:
    """``df`` with a unique long for every row, fixed by writing the table; ids may repeat or be null."""
    return written(df.withColumn(name, F.monotonically_increasing_id()), tag)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_written(spark: SparkSession) -> None:
    """Deletes all tables and archives that this process wrote to the shared folder; call it once results are stored."""
    while _made:
        remove(spark, _made.pop())


def release(spark: SparkSession) -> None:
    """Shuffle files of jobs that are done stay until the driver collects its garbage; this asks for it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Tables of one operator, deleted when it is left: ``with Scratch(spark) as s: s.written(...)``.

    What the operator returns must not read them; it is `written` on its own.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, []

    def __enter__(self) -> "Scratch":
        return self

    def written(self, df: DataFrame, tag: str) -> DataFrame:
        out = written(df, tag)
        self.held.append((out, _made[-1]))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes these tables early, and what their jobs left behind."""
        for table, path in [x for x in self.held if any(x[0] is t for t in tables)]:
            self.held = [x for x in self.held if x[0] is not table]
            self._remove(path)
        release(self.spark)

    def _remove(self, path: str) -> None:
        remove(self.spark, path)
        if path in _made:
            _made.remove(path)

    def __exit__(self, *failed) -> None:
        for _, path in self.held:
            self._remove(path)
        self.held = []
        release(self.spark)
