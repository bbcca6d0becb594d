import os

from tessera.llm import common as C
from tessera.operators import storage as S


def test_written_tables_can_be_dropped(spark):
    df = C.written(spark.range(5), "t")
    assert df.count() == 5
    paths = [p.removeprefix("file:") for p in S._made]
    assert all(os.path.isdir(p) for p in paths)
    C.drop_written(spark)
    assert not any(os.path.exists(p) for p in paths) and not S._made


def test_names_that_do_not_clash(spark):
    df = spark.createDataFrame([(1, 2)], "size int, _SIZE int")
    assert C.unused(df, "size", "size", "other") == ["__size", "___size", "other"]
