import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import models
from tessera.operators.hits import tripped
from tessera.plans import commands as C
from tessera.plans import workflow
from tessera.sources.files import InputError
from tessera.streaming.hits import run_available
from tessera.streaming.requests import tripped_stream


@pytest.fixture(scope="module")
def media(spark):
    rows = [("a/1.jpg", "a", "1.jpg", 100, 50, "RGB", None), ("a/2.png", "a", "2.png", 40, 80, "RGB", "x"), ("b/1.png", "b", "1.png", 64, 64, "L", None)]
    return spark.createDataFrame(rows, "path string, bucket string, name string, width int, height int, mode string, source string").withColumns({"license": F.lit(None).cast("string"), "origin": F.lit(None).cast("string")})


def test_wrong_arguments_raise_before_anything_runs(spark, media):
    wrong = [
        lambda: C.augment(media), lambda: C.annotate(media), lambda: C.format(media), lambda: C.format(media, fmt="gif"), lambda: C.frame(media),
        lambda: C.frame(media, width=5, margin=1, mode="pad"), lambda: C.frame(media, width=9, height=9, margin="60%", mode="pad"), lambda: C.upscale(media, scale=3),
        lambda: C.upscale(media, scale=2, denoise=0.5), lambda: C.extract_classes(media, width=1, height=1, classes=[]), lambda: C.extract_frames(media, keyframes=0),
        lambda: C.search(spark, terms=[]), lambda: C.search(spark, terms=["t"], suffixes=[" "], suffix_only=True), lambda: C.select(media, colour="red"), lambda: C.analyze(media, metrics=["taste"]),
    ]
    for call in wrong:
        with pytest.raises(InputError):
            call()
    for call in (C.detect, C.extract_faces):
        with pytest.raises(models.BackendMissing):
            call(media, factory=None)


def test_rows_of_commands(spark, media):
    assert {r.query for r in C.search(spark, terms=["cat"], suffixes=["", "photo"]).collect()} == {"cat", "cat photo"}
    assert C.augment(media, flip_x=True, no_copy=True).count() == 3
    assert [r.scaled_h for r in C.frame(media, width=20).orderBy("path").collect()] == [10, 40, 20]
    assert {(r.scaled_w, r.off_x) for r in C.frame(media.where("path = 'a/1.jpg'"), width=50, height=50, mode="pad", margin=5).collect()} == {(40, 5)}
    assert [(r.new_name, r.clash) for r in C.format(media, fmt="webp").orderBy("path").collect()] == [("1.webp", True), ("2.webp", False), ("1.webp", True)]
    assert [(r.width, r.upscale, len(r.tiles)) for r in C.upscale(media, scale=2, tile_size=64).orderBy("path").collect()] == [(200, 2, 2), (80, 2, 2), (128, 2, 1)]
    assert [r.path for r in C.select(media, min_side=70, source=["X"]).collect()] == ["a/2.png"]
    hits = spark.createDataFrame([("https://h.org/a.jpg", "600", "10"), ("https://h.org/a.jpg", None, None), ("https://h.org/s.svg", "900", "900"), ("https://h.org/t.jpg", "9", "9")], "url string, width string, height string")
    assert [r.url for r in C.fetch(hits).collect()] == ["https://h.org/a.jpg"]


def test_detector_backend(spark):
    def factory():
        def backend(frame):
            n = len(frame)
            return frame[["path"]].assign(**{"class": "Cat", "score": np.linspace(0.1, 0.9, n), "x0": 0.0, "y0": 0.0, "x1": 4.0, "y1": 4.0})

        return backend

    items = spark.createDataFrame([(f"p{i}", b"") for i in range(3)], "path string, content binary").coalesce(1)
    assert {(r.image, r["class"]) for r in C.detect(items, factory=factory, classes=["CAT"]).collect()} == {("p1", "cat"), ("p2", "cat")}


def test_analyze_measures_what_is_missing(spark):
    noise = np.random.default_rng(5).integers(0, 256, 32 * 32 * 3, dtype=np.uint8).tobytes()
    rows = [("new", None, None, (noise, 32, 32, 3)), ("done", {"blur": 1.0}, "0f", (noise, 32, 32, 3)), ("bad", None, None, (None, -1, -1, -1))]
    df = spark.createDataFrame(rows, "path string, metrics map<string,double>, phash string, image struct<data binary, width int, height int, nChannels int>")
    got = {r.path: r for r in C.analyze(df).collect()}
    assert got["done"].metrics == {"blur": 1.0} and got["done"].phash == "0f"
    assert got["new"].metrics["blur"] > 0 and len(got["new"].phash) == 16
    assert got["bad"].metrics is None and got["bad"].phash is None
    assert {r.path: r.metrics for r in C.analyze(df, force=True).collect()}["done"] == got["new"].metrics
    assert C.analyze(df, metrics=[], clear=True).where("cardinality(metrics) = 0 AND phash IS NULL").count() == 3


def test_clusters_or_an_error(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([c + 0.01 * rng.standard_normal((20, 4)) for c in (np.zeros(4), np.full(4, 5.0))])
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = C.cluster(vectors, top=1).collect()
    assert len(got) == 40 and {r.folder for r in got} == {"000", "noise"}
    with pytest.raises(C.PipelineError):
        C.cluster(vectors.limit(4))


TEXT = """
working_dir: sub
rename: {prefix: p_}
workflows:
  all:
    - select: {from: a}
    - exec: ls "${TESSERA_TABLE#file:}" > listing && exit 0
    - rename: {digits: 3}
    - extract-frames: {inherit: false, keyframes: 2}
  named: [select, {rename: {inherit: false, digits: 2}}, {exec: "exit 3"}]
  off: [{exec: " "}]
  flag: [{rename: {inherit: maybe}}]
"""


def test_workflow_plan_tells_and_runs_nothing():
    assert workflow.plan(TEXT, "all") == ["select bucket='a'", 'exec ls "${TESSERA_TABLE#file:}" > listing && exit 0', "rename prefix='p_' digits=3", "extract_frames keyframes=2"]
    assert workflow.load(TEXT, "named")[1] == ("rename", {"digits": 2})
    for name in ("off", "flag"):
        with pytest.raises(workflow.ConfigError):
            workflow.load(TEXT, name)


def test_workflow_commands_see_the_rows_so_far(spark, media, tmp_path):
    (tmp_path / "sub").mkdir()
    text = TEXT.replace("    - extract-frames: {inherit: false, keyframes: 2}\n", "")
    got = workflow.run(media, text, "all", base=str(tmp_path)).orderBy("path").collect()
    assert [r.name for r in got] == ["p_001.jpg", "p_002.png"]
    assert ".parquet" in (tmp_path / "sub" / "listing").read_text()
    with pytest.raises(C.PipelineError):
        workflow.run(media, text, "named", base=str(tmp_path))


def test_breaker_stream_equals_the_batch_operator(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(f"d{rng.integers(6)}", i, bool(rng.random() < 0.4)) for i in range(300)] + [("late", 400 + i, i == 0) for i in range(7)]
    schema = "domain string, event_id long, ok boolean"
    timed = lambda part: spark.createDataFrame(part, schema).withColumn("t", F.timestamp_seconds("event_id"))
    for k in range(0, len(rows), 50):
        timed(rows[k : k + 50]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(f"{schema}, t timestamp").parquet(str(tmp_path / "in"))
        run_available(tripped_stream(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("domain", "tripped_at").collect()))
    assert got == sorted(map(tuple, tripped(timed(rows)).collect())) and len(got) > 1
