import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import pixels as P
from tessera.operators import models
from tessera.plans import workflow
from tessera.sources import files as S
from tessera.streaming import hits as H


def picture(w, h, channels=3, seed=0):
    return np.random.default_rng(seed).integers(0, 255, (h, w, channels), dtype=np.uint8)


@pytest.fixture
def folders(tmp_path):
    for bucket, name, w in (("one", "a.PNG", 7), ("one", "b.png", 9), ("two", "c.png", 5)):
        (tmp_path / bucket).mkdir(exist_ok=True)
        (tmp_path / bucket / name).write_bytes(P.encode_png(picture(w, 6), 6))
    (tmp_path / "one" / "note.txt").write_text("x")
    (tmp_path / "one" / "a.PNG.json").write_text(json.dumps({"source": "s", "metrics": {"blur": 2.5}, "other": 1}))
    return tmp_path


def test_scan_resolve_and_sidecars(spark, folders):
    dirs = S.resolve_dirs(spark, "one, t*, one, none", str(folders))
    assert [d.rsplit("/", 1)[1] for d in dirs] == ["one", "two", "none"]
    with pytest.raises(S.InputError):
        S.scan(spark, dirs)
    media = S.scan(spark, dirs, strict=False, content=True)
    w, h = S.png_size(F.col("content"))
    got = {r.name: (r.bucket, r.w, r.h) for r in media.select("*", w.alias("w"), h.alias("h")).collect()}
    assert got == {"a.PNG": ("one", 7, 6), "b.png": ("one", 9, 6), "c.png": ("two", 5, 6)}
    joined = {r.name: (r.source, r.metrics) for r in S.with_sidecars(media, S.sidecars(spark, [str(folders / "one")])).collect()}
    assert joined == {"a.PNG": ("s", {"blur": 2.5}), "b.png": (None, None), "c.png": (None, None)}


def test_pixels_through_the_image_source(spark, folders):
    images = spark.read.format("image").load(str(folders / "one" / "*.png")).select("image.*")
    row = images.select(P.blur("data", "width", "height", "nChannels").alias("b"), P.phash("data", "width", "height", "nChannels").alias("p"), P.flip("X")("data", "width", "height", "nChannels").alias("f")).first()
    a = picture(9, 6)
    assert row.b == P.blur_of(a[:, :, :]) and row.p == P.phash_of(a) and len(row.p) == 16
    assert row.f == P.encode_png(P.flipped(a, "X"))


def test_pixel_functions():
    flat = np.full((20, 30, 3), 9, np.uint8)
    assert P.blur_of(flat) == 0.0 and P.content_box(flat) is None
    flat[4:9, 3:11] = 200
    assert P.content_box(flat) == (3, 4, 11, 9)
    a = picture(64, 48, seed=2)
    near = np.clip(a.astype(int) + 1, 0, 255).astype(np.uint8)
    assert (int(P.phash_of(a), 16) ^ int(P.phash_of(near), 16)).bit_count() <= 4
    assert (P.flipped(a, "XY") == a[::-1, ::-1]).all()
    assert P.png_is_compressed(P.encode_png(a, 0)) is False and P.png_is_compressed(P.encode_png(a, 9)) is True and P.png_is_compressed(b"x") is None


def test_hits_and_urls(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('{"url": "u", "width": 5}\n\n{broken\n{"url": "v", "title": null}\n')
    assert [(r.url, r.width) for r in S.read_hits(spark, str(tmp_path / "h.jsonl")).collect()] == [("u", "5"), ("v", None)]
    (tmp_path / "u.txt").write_text("# c\n\n https://www.flickr.com/x \nhttps://upload.wikimedia.org/y\n")
    assert [(r.url, r.source) for r in S.read_urls(spark, str(tmp_path / "u.txt")).collect()] == [("https://www.flickr.com/x", "flickr"), ("https://upload.wikimedia.org/y", "upload")]


def test_stream_keeps_one_hit_an_address(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for k, text in enumerate(('{"url": "a"}\n{"url": "b"}\n', '{"url": "a"}\n{bad\n{"url": "c"}\n')):
        (tmp_path / "in" / f"{k}.jsonl").write_text(text)
        H.run_available(H.first_hits(H.hit_stream(spark, str(tmp_path / "in"))), out, state)
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_workflow(spark):
    text = "select:\n  min_side: 5\nworkflows:\n  w:\n    - select: {from: one, source: [x]}\n    - annotate: {license: cc0}\n  bad: [nothing]\n  none: []\n"
    df = spark.createDataFrame([("p", "one", 8, 8, "x", None), ("q", "one", 4, 4, "x", None), ("r", "two", 8, 8, "x", None)], "path string, bucket string, width int, height int, source string, license string")
    assert [(r.path, r.license) for r in workflow.run(df, text, "w").collect()] == [("p", "cc0")]
    for name in ("bad", "none", "missing"):
        with pytest.raises(workflow.ConfigError):
            workflow.load(text, name)


def test_models_need_a_backend(spark):
    df = spark.createDataFrame([(f"p{i}", b"x") for i in range(70)], "path string, content binary")
    with pytest.raises(models.BackendMissing):
        models.apply_model(df, "embed", None)

    def factory():
        def backend(frame):
            assert len(frame) <= 32
            return frame[["path"]].assign(embedding=[[1.0]] * len(frame))

        return backend

    assert models.apply_model(df, "embed", factory).count() == 70
