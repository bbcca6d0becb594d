from datetime import datetime

from tessera.operators import acquire as A
from tessera.sources import cache


def test_plan_and_lanes(spark):
    urls = spark.createDataFrame([(f"https://upload.wikimedia.org/{i}",) for i in range(50)] + [("https://x.example/a",), ("https://youtu.be/b",), ("nonsense",)], "url string")
    rows = A.download_plan(urls).collect()
    wiki = [r for r in rows if r.host == "upload.wikimedia.org"]
    assert {r.lane for r in wiki} == {0, 1} and {r.lane_delay for r in wiki} == {1.4}
    assert [r.video for r in rows if "youtu" in r.url] == [True] and all(0 <= r.lane < 8 for r in rows)
    plan = A.download_plan(urls)
    assert A.pending(plan, plan.where("host = 'upload.wikimedia.org'")).count() == 3
    assert A.by_lane(plan, 4).count() == 53


def test_retry_waits():
    assert A.wait_before_retry(2, "1", None) is None and A.wait_before_retry(0, "7", None) == 7.0
    assert A.wait_before_retry(0, "7", 5.0) is None and 2 <= A.wait_before_retry(1, None, None) < 3
    assert 1 <= A.wait_before_retry(0, "soon", None) < 2


def test_embedding_cache(spark, tmp_path):
    folder = str(tmp_path / "cache")
    items = spark.createDataFrame([(f"p{i}", 5, datetime(2024, 1, 1)) for i in range(4)], "path string, length long, modificationTime timestamp")
    got, todo = cache.split(items, folder, "m")
    assert got is None and todo.count() == 4
    cache.append(todo.where("path < 'p2'").selectExpr("key", "array(1.0f) AS embedding"), folder)
    got, todo = cache.split(items, folder, "m")
    assert (got.count(), todo.count(), cache.split(items, folder, "other")[1].count()) == (2, 2, 4)
