"""Answers of image search engines, parsed by `from_json` and `explode` into one record schema.

`SearchSource` is a Python data source: one input partition a (query, page), so requests spread over
executors; it needs a network and a key, the parsers do not.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMAS = {
    "brave": "results array<struct<title:string,source:string,properties:struct<url:string,width:string,height:string>>>",
    "flickr": "stat string, photos struct<photo:array<struct<title:string,url_o:string,url_k:string,url_h:string,url_m:string,width_o:string,height_o:string,width_k:string,height_k:string,width_h:string,height_h:string,license:string,ownername:string,datetaken:string>>>",
    "inaturalist": "results array<struct<quality_grade:string,observed_on:string,taxon:struct<preferred_common_name:string,name:string>,photos:array<struct<url:string,license_code:string,attribution:string>>>>",
    "serper": "images array<struct<imageUrl:string,image:string,original_image_url:string,imageWidth:string,imageHeight:string,title:string,link:string>>",
    "wikimedia": "query struct<pages:map<string,struct<title:string,imageinfo:array<struct<url:string,mime:string,width:string,height:string,extmetadata:map<string,struct<value:string>>>>>>>",
}


def _filled(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def strip_html(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, "<[^>]+>", ""))


def _int(name: str) -> Column:
    return F.expr(f"try_cast({name} AS int)")


def _records(answers: DataFrame, engine: str) -> DataFrame:
    r = answers.withColumn("r", F.from_json("body", SCHEMAS[engine]))
    if engine == "brave":
        r = r.withColumn("x", F.explode("r.results")).where("x.properties IS NOT NULL")
        return r.withColumns({"url": F.col("x.properties.url"), "width": _int("x.properties.width"), "height": _int("x.properties.height"), "title": F.col("x.title"), "source_domain": F.col("x.source")})
    if engine == "flickr":
        r = r.where("r.stat = 'ok'").withColumn("x", F.explode("r.photos.photo"))
        sizes = lambda side: F.coalesce(*[F.when(F.col(f"x.width_{k}").isNotNull() & F.col(f"x.height_{k}").isNotNull(), _int(f"x.{side}_{k}")) for k in "okh"])
        return r.withColumns({"url": _filled("x.url_o", "x.url_k", "x.url_h", "x.url_m"), "width": sizes("width"), "height": sizes("height"), "title": F.col("x.title"), "author": F.col("x.ownername"), "date": F.col("x.datetaken")})
    if engine == "inaturalist":
        r = r.withColumn("o", F.explode("r.results")).withColumn("x", F.explode("o.photos"))
        url = F.regexp_replace("x.url", r"/(square|small|thumb|medium|large)\.", "/original.")
        none = F.lit(None).cast("int")
        return r.withColumns({"url": url, "width": none, "height": none, "title": _filled("o.taxon.preferred_common_name", "o.taxon.name"), "license": F.col("x.license_code"), "author": F.col("x.attribution"), "date": F.col("o.observed_on"), "quality_grade": F.col("o.quality_grade")})
    if engine == "serper":
        r = r.withColumn("x", F.explode("r.images"))
        return r.withColumns({"url": _filled("x.imageUrl", "x.image", "x.original_image_url"), "width": _int("x.imageWidth"), "height": _int("x.imageHeight"), "title": F.col("x.title"), "source_domain": F.try_parse_url("x.link", F.lit("AUTHORITY"))})
    r = r.select("*", F.explode("r.query.pages").alias("k", "p")).withColumn("x", F.explode("p.imageinfo")).where("startswith(x.mime, 'image/')")
    meta = lambda name: strip_html(F.try_element_at("x.extmetadata", F.lit(name))["value"])
    license = F.replace(F.lower(F.try_element_at("x.extmetadata", F.lit("LicenseShortName"))["value"]), F.lit(" "), F.lit("-"))
    return r.withColumns({"url": F.col("x.url"), "width": _int("x.width"), "height": _int("x.height"), "title": F.regexp_replace("p.title", "^File:", ""), "license": license, "author": meta("Artist"), "date": meta("DateTimeOriginal")})


FIELDS = ["url", "width", "height", "license", "source_domain", "title", "author", "date", "quality_grade"]


def parse(answers: DataFrame, engine: str, min_size: int | None = None) -> DataFrame:
    """Records of all answers (column body); other columns stay.  iNaturalist tells no sizes, so none are too small."""
    keep = answers.columns
    r = _records(answers, engine).where("url IS NOT NULL AND url <> ''")
    r = r.withColumns({f: F.lit(None).cast("string") for f in FIELDS if f not in r.columns})
    if min_size is not None and engine != "inaturalist":
        r = r.where(~F.coalesce(F.greatest("width", "height") < min_size, F.lit(False)) | F.col("width").isNull() | F.col("height").isNull())
    return r.select(*[c for c in keep if c != "body"], *FIELDS).withColumn("engine", F.lit(engine))


def sample_answers(pages: DataFrame, engine: str) -> DataFrame:
    """One answer a page (page_id, body), made from its address: what tests and queries parse."""
    p = F.col("page_id")
    s = p.cast("string")
    t = F.concat(F.lit("t"), s)
    url = F.col("url")
    body = {
        "brave": lambda: F.struct(F.array(F.struct(t.alias("title"), F.lit("x").alias("source"), F.struct(url.alias("url"), (800 + p).alias("width"), F.lit("600").alias("height")).alias("properties"))).alias("results")),
        "flickr": lambda: F.struct(F.lit("ok").alias("stat"), F.struct(F.array(F.struct(t.alias("title"), F.when(p % 2 == 0, url).otherwise("").alias("url_o"), F.concat(url, F.lit("_k")).alias("url_k"), F.lit("1024").alias("width_k"), F.lit("768").alias("height_k"))).alias("photo")).alias("photos")),
        "inaturalist": lambda: F.struct(F.array(F.struct(F.struct(F.when(p % 2 == 0, "oak").alias("preferred_common_name"), F.lit("Quercus").alias("name")).alias("taxon"), F.array(F.struct(F.concat(F.lit("https://i.example/"), s, F.lit("/square.jpg")).alias("url"))).alias("photos"))).alias("results")),
        "serper": lambda: F.struct(F.array(F.struct(F.lit("").alias("imageUrl"), url.alias("image"), F.lit(900).alias("imageWidth"), F.lit(700).alias("imageHeight"), t.alias("title"), url.alias("link"))).alias("images")),
        "wikimedia": lambda: F.struct(F.struct(F.create_map(s, F.struct(F.concat(F.lit("File:A"), s, F.lit(".jpg")).alias("title"), F.array(F.struct(url.alias("url"), F.when(p % 4 == 0, "video/ogg").otherwise("image/jpeg").alias("mime"), F.lit(1200).alias("width"), F.lit(900).alias("height"))).alias("imageinfo"))).alias("pages")).alias("query")),
    }[engine]()
    return pages.select("page_id", F.to_json(body).alias("body"))


class Page(InputPartition):
    def __init__(self, query: str, page: int):
        super().__init__((query, page))
        self.query, self.page = query, page


class SearchSource(DataSource):
    """``spark.read.format("tessera_search").option("url", template).option("queries", json).option("pages", n)``.

    The template holds ``{query}`` and ``{page}``; each answer is a row (query, page, body) for `parse`.
    """

    @classmethod
    def name(cls) -> str:
        return "tessera_search"

    def schema(self) -> str:
        return "query string, page int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _SearchReader(self.options)


class _SearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [Page(q, p) for q in json.loads(self.options["queries"]) for p in range(1, int(self.options.get("pages", "1")) + 1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        url = self.options["url"].format(query=urllib.parse.quote(partition.query), page=partition.page)
        with urllib.request.urlopen(url, timeout=float(self.options.get("timeout", "30"))) as answer:  # noqa: S310
            yield partition.query, partition.page, answer.read().decode("utf-8", "replace")


#: Engine names and the pages that a search asks each for unless told otherwise.
REGISTRY = {"brave": 1, "flickr": 40, "inaturalist": 50, "serper": 1, "wikimedia": 20}
