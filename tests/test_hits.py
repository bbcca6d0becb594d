from datetime import datetime

from tessera.operators import hits as H
from tessera.operators import report

FIELDS = ["url", "engine", "title"]


def test_richest_hit(spark):
    df = spark.createDataFrame([("u", "a", None, 1), ("u", "b", "t", 2), ("u", "c", "t", 3), ("v", "a", None, 4), ("v", "b", None, 5), ("", "a", "t", 6), (None, "a", "t", 7)], "url string, engine string, title string, ord long")
    got = {r.url: (r.engine, r.ord, r.first_ord) for r in H.richest_hits(df, FIELDS).collect()}
    assert got == {"u": ("b", 2, 1), "v": ("a", 4, 4)}


def test_query_matrix(spark):
    terms = spark.createDataFrame([(0, "cat"), (1, "dog")], "t long, term string")
    suffixes = spark.createDataFrame([(0, "photo"), (1, " "), (2, "portrait")], "s int, suffix string")
    got = [r.query for r in H.query_matrix(terms, suffixes).orderBy("part", "t", "s").collect()]
    assert got == ["cat", "dog", "cat photo", "cat portrait", "dog photo", "dog portrait"]
    assert H.query_matrix(terms, suffixes, True).count() == 4


def test_fetchable(spark):
    rows = [("https://x/a.jpg", "100", "100", "cc-by-4.0"), ("https://x/b.jpg", "2000", "1000", "cc-by-sa-4.0"), ("https://x/c.JPG", "100", "900", "CC-BY"), ("https://x/d.svg", None, "5", "cc-by"), ("https://x/e.gif?q", "x", "5", "cc-by"), ("", "900", "900", "cc-by"), ("https://x/f", "900", "900", None)]
    df = spark.createDataFrame(rows, "url string, width string, height string, license string")
    assert {r.url[-5:]: r.unsupported for r in H.fetchable(df, 512, ["cc-by"]).collect()} == {"b.jpg": False, "d.svg": True, "gif?q": True}
    assert H.fetchable(df, 512).count() == 5


def test_breaker(spark):
    rows = []
    for domain, outcomes in {"four": "ffff", "five": "sfffffs", "reset": "fffsffff"}.items():
        rows += [(domain, datetime(2024, 1, 1, 0, i), i, c == "s") for i, c in enumerate(outcomes)]
    df = spark.createDataFrame(rows, "domain string, t timestamp, event_id long, ok boolean")
    assert {r.domain: r.tripped_at for r in H.tripped(df).collect()} == {"five": datetime(2024, 1, 1, 0, 5)}


def test_greedy_frames(spark):
    df = spark.createDataFrame([("v", float(t)) for t in (0, 3, 9, 10, 12, 19, 20.5, 40)], "video string, t double")
    assert sorted(r.t for r in report.greedy_frames(df, 10.0).collect()) == [0.0, 10.0, 20.5, 40.0]


def test_validate(spark):
    schema = "width int, height int, mode string"
    check = lambda rows, square=False: report.validate(spark.createDataFrame(rows, schema), square).first().passed
    assert check([]) and check([(8, 8, "RGB")] * 2) and check([(8, 9, "RGB")])
    assert not check([(8, 8, "RGB"), (9, 9, "RGB")]) and not check([(8, 8, "RGB"), (8, 8, "L")])
    assert not check([(8, 9, "RGB")], True) and not check([(None, None, None)])
