import json

from tessera.sources import engines


def parsed(spark, engine, *bodies, min_size=None):
    df = spark.createDataFrame([(json.dumps(b),) for b in bodies], "body string")
    return engines.parse(df, engine, min_size).collect()


def test_brave_small_and_odd_sizes(spark):
    item = lambda u, w, h: {"title": "t", "source": "s", "properties": {"url": u, "width": w, "height": h}}
    got = parsed(spark, "brave", {"results": [item("a", 10, 10), item("b", "x", 10), item("", 999, 999), item("c", 999, 1)]}, min_size=512)
    assert [r.url for r in got] == ["b", "c"]


def test_flickr_first_size_and_failed_answer(spark):
    photo = {"title": "t", "url_o": "", "url_k": "k", "width_k": 7, "height_k": 8, "width_h": 1, "height_h": 2, "ownername": "me"}
    got = parsed(spark, "flickr", {"stat": "ok", "photos": {"photo": [photo]}}, {"stat": "fail"})
    assert [(r.url, r.width, r.height, r.author) for r in got] == [("k", 7, 8, "me")]


def test_inaturalist_original_size(spark):
    got = parsed(spark, "inaturalist", {"results": [{"taxon": {"name": "Quercus"}, "photos": [{"url": "https://i/1/square.jpg"}, {"url": "https://i/2/medium.png"}]}]}, min_size=512)
    assert [(r.url, r.title) for r in got] == [("https://i/1/original.jpg", "Quercus"), ("https://i/2/original.png", "Quercus")]


def test_wikimedia_images_only(spark):
    page = {"title": "File:A.jpg", "imageinfo": [{"url": "u", "mime": "image/jpeg", "extmetadata": {"LicenseShortName": {"value": "CC BY 4.0"}, "Artist": {"value": "<a href='x'>Me</a> "}}}]}
    other = {"title": "File:B.ogv", "imageinfo": [{"url": "v", "mime": "video/ogg"}]}
    got = parsed(spark, "wikimedia", {"query": {"pages": {"1": page, "2": other}}})
    assert [(r.url, r.title, r.license, r.author) for r in got] == [("u", "A.jpg", "cc-by-4.0", "Me")]


def test_serper(spark):
    got = parsed(spark, "serper", {"images": [{"imageUrl": None, "image": "i", "imageWidth": 3, "imageHeight": 4, "link": "https://h.x:80/p"}]})
    assert [(r.url, r.width, r.source_domain) for r in got] == [("i", 3, "h.x:80")]
