import pytest
from pyspark.sql import functions as F

from tessera.operators import select as S

SCHEMA = "path string, name string, width int, height int, metrics map<string,double>, classes map<string,array<struct<score:double,box:array<int>>>>, source string, license string"


def rows(spark, *items):
    base = {"path": "a", "name": "a", "width": 8, "height": 8, "metrics": None, "classes": None, "source": None, "license": None}
    data = [tuple((base | {"path": f"p{i}"} | x).values()) for i, x in enumerate(items)]
    return spark.createDataFrame(data, SCHEMA)


def reasons(spark, criteria, *items):
    return [r.reject_reason for r in S.select(rows(spark, *items), criteria).orderBy("path").collect()]


def face(score):
    return {"face": [(score, [0, 0, 1, 1])]}


@pytest.mark.parametrize(
    "criteria, items, expected",
    [
        (S.Criteria(min_metric=[("blur", 100)]), [{"metrics": {"blur": 50.0}}, {"metrics": {"blur": 100.0}}, {"metrics": {"x": 1.0}}], ["blur too low", None, "missing 'blur' metric data"]),
        (S.Criteria(max_metric=[("blur", 200)]), [{"metrics": {"blur": 150.0}}, {"metrics": {"blur": 250.0}}, {}], [None, "blur too high", "missing 'blur' metric data"]),
        (S.Criteria(min_detect=[("face", 0.5)]), [{"classes": face(0.9)}, {"classes": face(0.2)}, {"classes": {"cat": []}}, {}, {"classes": {}}], [None, "'face' below threshold", "'face' not detected", "missing detection data", "'face' not detected"]),
        (S.Criteria(max_detect=[("face", 0.9)]), [{"classes": face(0.9)}, {"classes": face(0.1)}, {"classes": {"face": []}}, {}], ["'face' detected", None, None, "missing detection data"]),
        (S.Criteria(source=["flickr", "brave"]), [{"source": "Flickr"}, {"source": "brave"}, {"source": "Wikimedia"}, {}], [None, None, "source not allowed", "missing source data"]),
        (S.Criteria(license=["CC0"]), [{"license": "cc0"}, {"license": "cc0-1.0"}, {}], [None, "license not allowed", "missing license data"]),
        (S.Criteria(min_side=9), [{}, {"width": None, "height": None}, {"height": 9}], ["side too small", None, None]),
        (S.Criteria(), [{}, {"width": None}], [None, None]),
    ],
)
def test_first_failing_stage_gives_the_reason(spark, criteria, items, expected):
    assert reasons(spark, criteria, *items) == expected


def test_skip_existing_keeps_the_first_path(spark):
    kept = spark.createDataFrame([("b/x", "x"), ("a/x", "x"), ("a/y", "y")], "path string, name string")
    out = S.not_at_destination(kept, spark.createDataFrame([("y",)], "name string"))
    assert [r.path for r in out.collect()] == ["a/x"]


def test_rename_numbers_and_padding(spark):
    df = spark.createDataFrame([(f"b{i % 2}", f"b{i % 2}/{i:02d}", f"{i:02d}.png") for i in range(12)], "bucket string, path string, name string")
    out = [r.new_name for r in S.rename(df, "n_").orderBy("bucket", "path").collect()]
    assert out == [f"n_{i:02d}.png" for i in range(1, 13)]


def test_merge_metrics_new_keys_win(spark):
    row = spark.range(1).select(S.merge_metrics(F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(2.0)), F.create_map(F.lit("b"), F.lit(3.0))).alias("m")).first()
    assert row.m == {"a": 1.0, "b": 3.0}


def test_annotate_fills_only_missing(spark):
    out = S.annotate(rows(spark, {"source": "x"}, {}), source="y", license=None).orderBy("path").collect()
    assert [(r.source, r.changed) for r in out] == [("x", False), ("y", True)]
