import random
from urllib.parse import urlencode

import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import urls as U


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://a.x/i.jpg?w=10&id=3&h=2#f", "https://a.x/i.jpg?id=3#f"),
        ("https://a.x/i.jpg?w=10", "https://a.x/i.jpg"),
        ("https://a.x/i.jpg?id=%20a", "https://a.x/i.jpg?id=%20a"),
        ("https://a.x/i.jpg", "https://a.x/i.jpg"),
        ("https://a.x/i?k=1&k=2&q=9", "https://a.x/i?k=1&k=2"),
    ],
)
def test_clean_url(spark, url, want):
    assert one(spark, U.clean_url(F.col("u")), u=url) == want
    assert one(spark, U.clean_url_exact(F.col("u")), u=url) == want


def test_keep_all_hosts(spark):
    assert one(spark, U.clean_url(F.col("u"), keep_hosts=["a.x"]), u="https://A.x/i?w=1") == "https://A.x/i?w=1"


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://p.x/?url=https%3A%2F%2Fb.y%2Fi.jpg", "https://b.y/i.jpg"),
        ("https://p.x/?url=http://b.y/i.jpg", "http://b.y/i.jpg"),
        ("https://p.x/?url=ftp%3A%2F%2Fb", "https://p.x/?url=ftp%3A%2F%2Fb"),
        ("https://p.x/?url=javascript:1", "https://p.x/?url=javascript:1"),
        ("https://p.x/?url=http://a&url=http://b", "https://p.x/?url=http://a&url=http://b"),
        ("https://p.x/?url=", "https://p.x/?url="),
        ("https://p.x/?url=%20http://b.y%20", "http://b.y"),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, U.canonical_url(F.col("u")), u=url) == want


def test_video_hosts(spark):
    got = [one(spark, U.needs_video_tool(F.col("u")), u=u) for u in ("https://YOUTU.be/x", "https://m.youtube.com/x", "https://notyoutube.com/x", "nonsense")]
    assert got == [True, True, False, False]


def test_source_of(spark):
    got = [one(spark, U.source_of(F.col("u")), u=u) for u in ("https://www.flickr.com/a", "https://upload.wikimedia.org/b", "nonsense")]
    assert got == ["flickr", "upload", "unknown"]


def test_margins_of_random_canvases():
    rng = random.Random(11)
    for _ in range(300):
        w, h = rng.randrange(20, 3000), rng.randrange(20, 3000)
        pixels, percent = rng.randrange(0, 1600), rng.randrange(0, 700) / 10
        blank = rng.choice(["", " ", "\t"])
        for value, want in ((pixels, pixels), (f"{blank}{pixels}{blank}", pixels), (f"{percent}%{blank}", round(percent / 100 * min(w, h)))):
            if 2 * want >= min(w, h):
                with pytest.raises(ValueError, match="no room"):
                    G.resolve_margin(value, w, h)
            else:
                assert G.resolve_margin(value, w, h) == want
    assert G.resolve_margin(None, 3, 3) == 0


def test_what_is_no_margin():
    rng = random.Random(12)
    for _ in range(300):
        n = rng.randrange(1, 40)
        value = rng.choice([f"{n} %", f"-{n}", f"-{n}%", f"{n}.{n}", f"{n}px", f"%{n}", "x" * n, f"{n}%%", f"{n} {n}", "%", " "])
        with pytest.raises(ValueError, match="not a margin"):
            G.resolve_margin(value, 1000, 1000)


def test_queries_are_encoded_again_like_forms(spark):
    rng = random.Random(13)
    names = ["w", "h", "id", "a b", "é", "x*", "~t", "quality", "k&"]
    urls = []
    for _ in range(60):
        pairs = [(rng.choice(names), rng.choice(["", "1", "a b", "ü/é", "50%", "~*", "="])) for _ in range(rng.randrange(1, 6))]
        urls.append(("https://a.x/p?" + urlencode(pairs) + rng.choice(["", "#f"]), pairs))
    got = [r.x for r in spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "i int, u string").select("i", U.clean_url_exact(F.col("u")).alias("x")).orderBy("i").collect()]
    for (url, pairs), x in zip(urls, got):
        kept = [p for p in pairs if p[0] not in U.RESIZE_PARAMETERS]
        if len(kept) == len(pairs):
            assert x == url
            continue
        order = list(dict.fromkeys(k for k, _ in kept))
        query = urlencode(sorted(kept, key=lambda p: order.index(p[0])))
        assert x == "https://a.x/p" + ("?" + query if query else "") + ("#f" if url.endswith("#f") else "")


@pytest.mark.parametrize(
    "box, margin, square, size",
    [((10.2, 10.7, 269.6, 270.9), 0.0, True, (1000, 1000)), ((5.0, 5.0, 295.0, 295.0), 0.1, True, (300, 300)), ((0.0, 0.0, 100.0, 40.0), 0.0, True, (300, 300)), ((-10.0, -10.0, 310.0, 310.0), 0.0, False, (300, 300))],
)
def test_crops_stay_inside(spark, box, margin, square, size):
    values = dict(zip(("a", "b", "c", "d"), box), w=size[0], h=size[1])
    crop = G.clamp_crop(G.expand_box(*[F.col(c) for c in "abcd"], margin, square), F.col("w"), F.col("h"), square)
    x0, y0, x1, y1 = one(spark, F.array(*crop), **values)
    assert 0 <= x0 < x1 <= size[0] and 0 <= y0 < y1 <= size[1]
    assert not square or x1 - x0 == y1 - y0


def test_scale_boxes(spark):
    classes = F.create_map(F.lit("a"), F.array(F.struct(F.lit(0.5).alias("score"), F.array(F.lit(50), F.lit(101), F.lit(-3), F.lit(201)).alias("box"))))
    assert one(spark, G.scale_classes(classes, 0.5))["a"][0].box == [25, 50, -1, 100]
