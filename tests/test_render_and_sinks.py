import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import faces, pixels, render
from tessera.sources import files, headers, sinks


def picture(w, h, channels=3, seed=0):
    return np.random.default_rng(seed).integers(0, 255, (h, w, channels), dtype=np.uint8)


def test_resampling_keeps_flat_and_smooth_pictures():
    flat = np.full((37, 21, 3), 77, np.uint8)
    for size in ((10, 50), (21, 37), (200, 9)):
        out = render.resized(flat, *size)
        assert out.shape == (size[1], size[0], 3) and (out == 77).all()
    ramp = np.repeat(np.linspace(0, 240, 64)[None, :, None], 8, axis=0).astype(np.uint8)
    half = render.resized(ramp, 32, 4)[2, 4:-4, 0].astype(int)
    assert (abs(half - np.linspace(0, 240, 64).reshape(32, 2).mean(1)[4:-4]) <= 2).all()


@pytest.mark.parametrize("fill", ["color", "edge", "reflect", "blur"])
@pytest.mark.parametrize("gravity", ["center", "top-left", "bottom"])
def test_padding_places_the_picture(fill, gravity):
    a = picture(40, 20)
    out = render.framed(a, 60, 60, "pad", gravity, fill, "#102030", margin=5)
    small = render.resized(a, 50, 25)
    y = 5 + round((50 - 25) * {"center": 0.5, "top-left": 0, "bottom": 1}[gravity])
    assert out.shape == (60, 60, 3) and (out[y : y + 25, 5:55] == small).all()
    if fill == "color":
        assert out[0, 0].tolist() == [0x30, 0x20, 0x10]
    if fill == "edge":
        assert (out[y + 3, :5] == small[3, 0]).all()
    if fill == "reflect":
        assert (out[y + 3, :5] == small[3, 5:0:-1]).all()


def test_frames():
    a = picture(40, 20)
    assert render.framed(a, width=10).shape == (5, 10, 3) and render.framed(a, height=40).shape == (40, 80, 3)
    assert (render.framed(a, 40, 20) == a).all()
    assert render.framed(a, 7, 9, "stretch").shape == (9, 7, 3)
    big = render.resized(a, 60, 30)
    assert (render.framed(a, 30, 30, "crop", "right") == big[:, 30:]).all()
    edged = np.full((30, 30, 3), 200, np.uint8)
    edged[10:20, 5:25] = picture(20, 10, seed=3) // 2
    assert render.framed(edged, trim=True).shape == (10, 20, 3)
    with pytest.raises(render.NoContent):
        render.framed(np.full((4, 4, 3), 9, np.uint8), trim=True)
    for wrong in ({"mode": "x"}, {"mode": "pad", "fill": "x"}, {"mode": "pad", "colour": "#12"}):
        with pytest.raises(ValueError):
            render.framed(a, 9, 9, **wrong)


def test_channels():
    a = picture(5, 4, 4)
    a[0, 0] = (10, 20, 30, 0)
    a[0, 1] = (10, 20, 30, 255)
    flat = render.flattened(a, "#0000ff")
    assert flat[0, 0].tolist() == [255, 0, 0] and flat[0, 1].tolist() == [10, 20, 30]
    assert render.with_channels(a, "grayscale").shape == (4, 5, 1) and render.with_channels(a[:, :, :1], "rgb").shape == (4, 5, 3)
    assert (render.with_channels(a[:, :, :3], "grayscale")[:, :, 0] == pixels.gray(a[:, :, :3])).all()
    with pytest.raises(ValueError):
        render.with_channels(a, "cmyk")


def test_corner_median_is_cut():
    a = np.zeros((4, 4, 3), np.uint8)
    a[0, 0] = a[0, -1] = 1  # the corners' median is 0.5, cut to 0
    a[2, 1] = 9
    assert pixels.content_box(a, 8) == (1, 2, 2, 3)


def landmarks(n, rng, turn=1 + 0j, at=0j):
    points = np.array([at + turn * complex(*rng.normal(0, 30, 2)) for _ in range(n)])
    left, right, mouth = faces.PARTS[n]
    points[list(left)], points[list(right)], points[list(mouth)] = at + turn * (-50 - 20j), at + turn * (50 - 20j), at + turn * 60j
    return np.stack([points.real, points.imag], 1)


@pytest.mark.parametrize("n", [68, 468, 478])
def test_face_squares(spark, n):
    rng = np.random.default_rng(n)
    upright = faces.face_quad(landmarks(n, rng, at=500 + 500j))
    # Eyes 100 apart, the mouth 80 below: half side 2 * 100; the centre a tenth of the way down.
    assert np.allclose(upright, [[300, 288], [300, 688], [700, 688], [700, 288]])
    assert faces.face_size(upright) == 400 and faces.face_size(upright, 256) == 256
    assert not faces.is_partial(upright, 1000, 1000) and faces.is_partial(upright, 699, 1000)
    for degrees in (30, 90, 200):
        turn = np.exp(1j * np.radians(degrees))
        turned = faces.face_quad(landmarks(n, rng, turn))
        back = (turned[:, 0] + 1j * turned[:, 1]) / turn
        assert np.allclose(np.stack([back.real, back.imag], 1) + 500, upright)
    df = spark.createDataFrame([(landmarks(n, rng, at=500 + 500j).tolist(),), ([[1.0, 2.0]],), (None,)], "points array<array<double>>")
    got = [r.f for r in df.select(faces.align("points").alias("f")).collect()]
    assert np.allclose(np.array(got[0].quad).reshape(4, 2), upright) and [g.size for g in got] == [400, None, None]
    with pytest.raises(ValueError):
        faces.face_quad(np.zeros((5, 2)))


def test_headers(spark):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff\xc2" + struct.pack(">HBHHB", 17, 8, 40, 30, 3) + b"\0" * 20
    tiff = lambda o, m: m + struct.pack(o + "IH", 8, 3) + b"".join(struct.pack(o + "HHI", t, k, 1) + (struct.pack(o + "HH", v, 0) if k == 3 else struct.pack(o + "I", v)) for t, k, v in ((256, 3, 11), (257, 4, 12), (277, 3, 4)))
    cases = {
        pixels.encode_png(picture(7, 6)): ("png", 7, 6, 3), pixels.encode_png(picture(7, 6, 4)): ("png", 7, 6, 4), pixels.encode_png(picture(7, 6, 1)): ("png", 7, 6, 1),
        b"GIF89a" + struct.pack("<HH", 5, 9): ("gif", 5, 9, 3),
        b"BM" + b"\0" * 12 + struct.pack("<IiiHH", 40, 8, -9, 1, 32): ("bmp", 8, 9, 4), b"BM" + b"\0" * 12 + struct.pack("<IHHHH", 12, 8, 9, 1, 24): ("bmp", 8, 9, 3),
        jpeg: ("jpeg", 30, 40, 3),
        b"RIFF0000WEBPVP8X" + struct.pack("<I", 10) + b"\x10\0\0\0" + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"): ("webp", 100, 50, 4),
        b"RIFF0000WEBPVP8L" + struct.pack("<I", 5) + b"\x2f" + (99 | 49 << 14 | 1 << 28).to_bytes(4, "little"): ("webp", 100, 50, 4),
        b"RIFF0000WEBPVP8 " + struct.pack("<I", 10) + b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 100, 50): ("webp", 100, 50, 3),
        tiff("<", b"II*\0"): ("tiff", 11, 12, 4), tiff(">", b"MM\0*"): ("tiff", 11, 12, 4),
        b"junk": None, b"": None, jpeg[:12]: None, b"\x89PNG\r\n\x1a\n": None,
    }
    assert {k: headers.header_of(k) for k in cases} == cases
    df = spark.createDataFrame([(i, bytearray(k)) for i, k in enumerate(cases)] + [(len(cases), None)], "i int, c binary")
    got = [tuple(r.h) for r in df.select("i", headers.image_header("c").alias("h")).orderBy("i").collect()]
    assert got == [v or (None,) * 4 for v in [*cases.values(), None]]


@pytest.mark.parametrize("move", [False, True])
def test_items_and_sidecars_are_placed(spark, tmp_path, move):
    for bucket in ("a", "b"):
        (tmp_path / bucket).mkdir()
        for i in range(3):
            (tmp_path / bucket / f"{i}.png").write_bytes(f"{bucket}{i}".encode())
    (tmp_path / "a" / "1.png.json").write_text("{}")
    items = files.scan(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).union(files.scan(spark, [str(tmp_path / "a")]).withColumns({"path": F.lit("/none/9.png"), "name": F.lit("9.png")}))
    got = {r.target.rsplit("/", 1)[1]: (r.sidecar, r.error is None) for r in sinks.place_items(items, f"file://{tmp_path}/out", move).collect()}
    assert got == {"0.png": (False, True), "1.png": (True, True), "2.png": (False, True), "9.png": (False, False)}
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["0.png", "1.png", "1.png.json", "2.png"]
    assert (tmp_path / "out" / "0.png").read_text() == "a0"
    assert (tmp_path / "a" / "1.png").exists() == (not move) and (tmp_path / "a" / "1.png.json").exists() == (not move) and (tmp_path / "b" / "1.png").exists()
    with pytest.raises(files.InputError):
        sinks.place_items(items, "out")


def test_hits_are_merged_into_a_file(spark, tmp_path):
    path = f"file://{tmp_path}/hits.jsonl"
    one = spark.createDataFrame([("u", "é", None), ("v", None, None), ("", "x", None)], "url string, title string, author string")
    assert sinks.write_hits(spark, one, path) == 2
    two = spark.createDataFrame([("v", "t", "a"), ("u", "other", None), ("w", None, None)], "url string, title string, author string")
    assert sinks.write_hits(spark, two, path) == 3
    assert {(r.url, r.title, r.author) for r in files.read_hits(spark, path).collect()} == {("u", "é", None), ("v", "t", "a"), ("w", None, None)}
    lines = [x for p in (tmp_path / "hits.jsonl").glob("part-*") for x in p.read_text(encoding="utf-8").splitlines()]
    assert any("é" in x for x in lines) and all(json.loads(x) for x in lines)
