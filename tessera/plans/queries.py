"""The registered queries of the catalog operators, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import catalog
from ..functions import geometry, urls
from ..operators import dedup, detections, hits, report, select
from ..sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MEDIA = """media AS (SELECT doc_id, 'b' || (doc_id % 4) || '/doc_' || doc_id || '.jpg' AS path, 'b' || (doc_id % 4) AS bucket, 'doc_' || doc_id || '.jpg' AS name,
CASE WHEN doc_id % 97 <> 0 THEN CAST(256 + (doc_id * 37) % 1793 AS INT) END AS width, CASE WHEN doc_id % 97 <> 0 THEN CAST(256 + (doc_id * 53) % 1531 AS INT) END AS height,
CASE doc_id % 3 WHEN 0 THEN 'RGB' WHEN 1 THEN 'RGBA' ELSE 'L' END AS mode, n_chars AS file_size, CASE WHEN doc_id % 11 <> 0 THEN (n_chars % 1000) / 10.0 END AS blur,
CASE WHEN doc_id % 29 <> 0 THEN substr(md5(text), 1, 15) || substr('0123456789abcdef', CAST(doc_id % 16 AS INT) + 1, 1) END AS phash,
CASE WHEN doc_id % 7 <> 1 THEN source END AS source, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'CC0' WHEN 2 THEN 'cc-by' ELSE 'none' END AS license,
doc_id % 7 = 0 AS upscale, doc_id % 13 <> 0 AS has_classes,
CASE WHEN doc_id % 13 <> 0 AND doc_id % 3 <> 0 THEN (doc_id % 100) / 100.0 END AS face, CASE WHEN doc_id % 13 <> 0 AND doc_id % 5 = 0 THEN (doc_id % 10) / 10.0 END AS cat FROM documents)"""
HITS = """hits AS (SELECT CASE WHEN page_id % 17 = 0 THEN '' WHEN page_id % 23 = 0 THEN NULL ELSE split_part(url, '?', 1) END AS url, 'brave' AS engine,
CAST(200 + page_id * 7 % 1500 AS VARCHAR) AS width, CASE WHEN page_id % 4 <> 0 THEN CAST(200 + page_id * 11 % 1500 AS VARCHAR) END AS height,
CASE WHEN page_id % 3 = 0 THEN 't' || page_id END AS title, CASE WHEN page_id % 5 = 0 THEN 'someone' END AS author,
CASE page_id % 5 WHEN 0 THEN 'cc-by-4.0' WHEN 1 THEN 'cc-by-sa-4.0' WHEN 2 THEN 'CC0' WHEN 3 THEN '' END AS license, page_id AS ord FROM pages
UNION ALL SELECT CASE WHEN page_id % 17 = 0 THEN '' WHEN page_id % 23 = 0 THEN NULL ELSE split_part(url, '?', 1) END, 'flickr', '800', CASE WHEN page_id % 2 = 0 THEN '600' END,
CASE WHEN page_id % 2 = 0 THEN 'u' || page_id END, CASE WHEN page_id % 4 = 0 THEN 'else' END, 'cc-by-2.0', page_id + 1000000000 FROM pages)"""
DETECTIONS = """detections AS (SELECT l_orderkey AS image, l_returnflag AS class, l_discount * 8 AS score, CAST(l_partkey * 13 % 600 AS INT) AS x0, CAST(l_suppkey * 17 % 440 AS INT) AS y0,
CAST(l_partkey * 13 % 600 + 8 + (l_linenumber * 29) % 120 AS INT) AS x1, CAST(l_suppkey * 17 % 440 + 8 + (l_linenumber * 31) % 100 AS INT) AS y1,
l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_tax FROM lineitem)"""
ORD = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_tax"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# Filters

_SIDE = "CASE WHEN greatest(width, height) < 600 THEN 'side too small' WHEN greatest(width, height) > 1700 THEN 'side too large' WHEN width < 400 THEN 'width too small' WHEN width > 1600 THEN 'width too large' WHEN height < 350 THEN 'height too small' WHEN height > 1500 THEN 'height too large' END"
_SIZES = {"min_side": 600, "max_side": 1700, "min_width": 400, "max_width": 1600, "min_height": 350, "max_height": 1500}


def _select(criteria: select.Criteria) -> Query:
    return lambda spark, d: select.select(catalog.media(spark, d), criteria).select("path", "reject_reason")


def _select_sql(case: str) -> str:
    return f"WITH {MEDIA} SELECT path, {case} AS reject_reason FROM media"


query("fl1_dimensions", _select_sql(f"CASE WHEN width IS NULL THEN NULL ELSE {_SIDE} END"))(_select(select.Criteria(**_SIZES)))
query("fl2_unreadable_kept", f"WITH {MEDIA} SELECT path FROM media WHERE width IS NULL")(
    lambda spark, d: select.select(catalog.media(spark, d), select.Criteria(**_SIZES)).where("reject_reason IS NULL AND width IS NULL").select("path")
)
query("fl3_metric_floor", _select_sql("CASE WHEN blur IS NULL THEN 'missing ''blur'' metric data' WHEN blur < 40 THEN 'blur too low' END"))(_select(select.Criteria(min_metric=[("blur", 40.0)])))
query("fl4_metric_ceiling", _select_sql("CASE WHEN blur IS NULL THEN 'missing ''blur'' metric data' WHEN blur < 20 THEN 'blur too low' WHEN blur > 70 THEN 'blur too high' END"))(
    _select(select.Criteria(min_metric=[("blur", 20.0)], max_metric=[("blur", 70.0)]))
)
query("fl5_fl6_max_detect", _select_sql("CASE WHEN NOT has_classes THEN 'missing detection data' WHEN face >= 0.5 THEN '''face'' detected' END"))(_select(select.Criteria(max_detect=[("face", 0.5)])))
query("fl7_min_detect", _select_sql("CASE WHEN NOT has_classes THEN 'missing detection data' WHEN cat IS NULL THEN '''cat'' not detected' WHEN cat < 0.3 THEN '''cat'' below threshold' END"))(
    _select(select.Criteria(min_detect=[("cat", 0.3)]))
)
query("fl8_source_list", _select_sql("CASE WHEN source IS NULL THEN 'missing source data' WHEN lower(source) NOT IN ('src1', 'src2', 'src0') THEN 'source not allowed' END"))(
    _select(select.Criteria(source=["SRC1", "src2", "Src0"]))
)
query("fl9_license_list", _select_sql("CASE WHEN license IS NULL THEN 'missing license data' WHEN lower(license) NOT IN ('cc0', 'cc-by') THEN 'license not allowed' END"))(_select(select.Criteria(license=["cc0", "CC-BY"])))
query("fl10_no_criteria", _select_sql("CAST(NULL AS VARCHAR)"))(_select(select.Criteria()))
_ALL = select.Criteria(min_side=600, min_metric=[("blur", 10.0)], max_metric=[("blur", 90.0)], max_detect=[("face", 0.9)], min_detect=[("face", 0.1)], source=["src0", "src3", "src5"], license=["cc0", "cc-by", "none"])
_ALL_SQL = """CASE WHEN greatest(width, height) < 600 AND width IS NOT NULL THEN 'side too small' WHEN blur IS NULL THEN 'missing ''blur'' metric data' WHEN blur < 10 THEN 'blur too low'
WHEN blur > 90 THEN 'blur too high' WHEN NOT has_classes THEN 'missing detection data' WHEN face >= 0.9 THEN '''face'' detected' WHEN face IS NULL THEN '''face'' not detected'
WHEN face < 0.1 THEN '''face'' below threshold' WHEN source IS NULL THEN 'missing source data' WHEN lower(source) NOT IN ('src0', 'src3', 'src5') THEN 'source not allowed'
WHEN license IS NULL THEN 'missing license data' WHEN lower(license) NOT IN ('cc0', 'cc-by', 'none') THEN 'license not allowed' END"""
query("select_all_stages", _select_sql(_ALL_SQL))(_select(_ALL))
query("fl11_reject_report", f"WITH {MEDIA} SELECT * FROM (SELECT name, {_ALL_SQL} AS reject_reason FROM media) WHERE reject_reason IS NOT NULL ORDER BY name LIMIT 10")(
    lambda spark, d: select.select(catalog.media(spark, d), _ALL).where("reject_reason IS NOT NULL").select("name", "reject_reason").orderBy("name").limit(10)
)
query(
    "fl12_fetchable",
    f"""WITH {HITS} SELECT ord, url, coalesce(lower(regexp_extract(regexp_replace(url, '^https?://[^/]*', ''), '(\\.[^./]+)$', 1)), '') IN ('.djvu', '.svg', '.gif') AS unsupported FROM hits
WHERE NOT coalesce(greatest(TRY_CAST(width AS INT), TRY_CAST(height AS INT)) < 512 AND width IS NOT NULL AND height IS NOT NULL, false) AND license LIKE 'cc-by%' AND url <> ''""",
)(lambda spark, d: hits.fetchable(catalog.hits(spark, d), 512, ["cc-by"]).select("ord", "url", "unsupported"))
query("fl13_video_router", "SELECT page_id, page_id % 3 = 0 AS video FROM pages")(
    lambda spark, d: catalog.read(spark, d, "pages").select("page_id", urls.needs_video_tool(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://WWW.Vimeo.com/"), F.col("page_id").cast("string"))).otherwise(F.col("url"))).alias("video"))
)
query("fl14_pending_metrics", f"WITH {MEDIA} SELECT path, CASE WHEN blur IS NULL THEN 'blur,musiq' ELSE 'musiq' END AS todo FROM media")(
    lambda spark, d: select.pending_metrics(catalog.media(spark, d), ["blur", "musiq"]).select("path", F.array_join("todo", ",").alias("todo"))
)
query("fl15_annotate_missing", f"WITH {MEDIA} SELECT path, coalesce(source, 'archive') AS source, coalesce(license, 'cc-by-4.0') AS license, source IS NULL OR license IS NULL AS changed FROM media")(
    lambda spark, d: select.annotate(catalog.media(spark, d), source="archive", license="cc-by-4.0").select("path", "source", "license", "changed")
)
query("fl15_annotate_overwrite", f"WITH {MEDIA} SELECT path, 'archive' AS source, true AS changed FROM media")(
    lambda spark, d: select.annotate(catalog.media(spark, d), overwrite=True, source="archive").select("path", "source", "changed")
)
query("fl16_clear_metrics", f"WITH {MEDIA} SELECT path, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS phash FROM media")(
    lambda spark, d: catalog.media(spark, d).withColumns({c: F.lit(None).cast("string") for c in ("source", "phash")}).select("path", "source", "phash")
)
query("fl17_clear_detections", f"WITH {MEDIA} SELECT path, source, false AS has_classes FROM media")(
    lambda spark, d: catalog.media(spark, d).withColumn("classes", F.lit(None).cast(catalog.CLASSES)).select("path", "source", F.col("classes").isNotNull().alias("has_classes"))
)
query("fl18_rename", f"WITH {MEDIA} SELECT path, n AS number, 'img_' || lpad(CAST(n AS VARCHAR), CAST(greatest(length(CAST((SELECT count(*) FROM media) AS VARCHAR)), length(CAST(n AS VARCHAR))) AS INT), '0') || '.jpg' AS new_name FROM (SELECT path, row_number() OVER (ORDER BY bucket, path) AS n FROM media)")(
    lambda spark, d: select.rename(_shared(spark, catalog.media(spark, d)), "img_").select("path", "number", "new_name")
)
query("fl19_review_apply", f"WITH {MEDIA} SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'source' ELSE 'filtered' END AS view FROM media")(
    lambda spark, d: (lambda m, chosen: m.join(chosen, "path", "left_semi").select("path", F.lit("source").alias("view")).union(m.join(chosen, "path", "left_anti").select("path", F.lit("filtered"))))(
        catalog.media(spark, d), catalog.media(spark, d).where("doc_id % 3 = 0").select("path")
    )
)
query("fl20_review_listing", f"WITH {MEDIA} SELECT name, coalesce(width, 0) AS width, coalesce(height, 0) AS height, file_size FROM media WHERE bucket = 'b1'")(
    lambda spark, d: catalog.media(spark, d).where("bucket = 'b1'").select("name", F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height"), "file_size")
)
query("fl21_buckets", f"WITH {MEDIA} SELECT bucket, count(*) AS images FROM media GROUP BY bucket HAVING count(*) > 0")(lambda spark, d: catalog.media(spark, d).groupBy("bucket").agg(F.count("*").alias("images")))


def _shared(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Sets a checkpoint folder where none is set (tests, one machine)."""
    from ..operators.storage import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return df


# Scans and sinks

_SUFFIXES = [".jpg", ".PNG", ".jpeg", ".bmp", ".txt", ".mp4", ".WebP", ".mov", ".json"]
_LISTED = "listing AS (SELECT 'b' || (doc_id % 4) || '/f' || doc_id || (CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SUFFIXES)) + " END) AS path FROM documents)"


def _listing(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("doc_id")
    return catalog.read(spark, d, "documents").select(F.concat(F.lit("b"), (doc % 4).cast("string"), F.lit("/f"), doc.cast("string"), F.element_at(F.array(*[F.lit(s) for s in _SUFFIXES]), (doc % 9 + 1).cast("int"))).alias("path"))


for _name, _kinds in (("sc1_scan_images", catalog.IMAGE_SUFFIXES), ("sc2_scan_videos", catalog.VIDEO_SUFFIXES)):
    _in = ", ".join(f"'{s}'" for s in _kinds)
    query(_name, f"WITH {_LISTED} SELECT path FROM listing WHERE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ({_in})")(
        lambda spark, d, kinds=_kinds: _listing(spark, d).where(urls.suffix(F.col("path")).isin(kinds))
    )
def _labels_as_sidecars(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("file:/m/"), F.col("doc_id").cast("string"))
    return files.with_sidecars(
        catalog.read(spark, d, "documents").select("doc_id", path.alias("path")), catalog.read(spark, d, "labels").select(path.alias("path"), "quality", "toxic", F.lit(True).alias("s"))
    ).select("doc_id", "quality", "toxic", F.coalesce("s", F.lit(False)).alias("has_sidecar"))


query("sc6_jn1_sidecar_lookup", "SELECT d.doc_id, l.quality, l.toxic, l.doc_id IS NOT NULL AS has_sidecar FROM documents d LEFT JOIN labels l USING (doc_id)")(_labels_as_sidecars)


def _json_lines(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return catalog.read(spark, d, "events").select(e, F.when(e % 7 == 0, "").when(e % 11 == 0, "{broken").otherwise(F.col("props")).alias("line"))


query("sc8_json_lines", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0")(
    lambda spark, d: files.json_lines(_json_lines(spark, d), "k long")
)
query(
    "sc9_url_list",
    """SELECT page_id, trim(url) AS url, coalesce(nullif(split_part(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\\.', ''), '.', 1), ''), 'unknown') AS source FROM pages WHERE page_id % 5 <> 0 AND trim(url) <> ''""",
)(
    lambda spark, d: files.url_lines(catalog.read(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("# "), F.col("url"))).otherwise(F.col("url")).alias("line"))).select("page_id", "url", "source")
)
query("sk2_merge_metrics", f"WITH {MEDIA} SELECT path, CASE WHEN doc_id % 2 = 0 THEN 1.5 ELSE blur END AS blur, CAST(2.0 AS DOUBLE) AS niqe FROM media")(
    lambda spark, d: catalog.media(spark, d).withColumn("m", select.merge_metrics(F.col("metrics"), F.map_filter(F.create_map(F.lit("blur"), F.when(F.col("doc_id") % 2 == 0, F.lit(1.5)), F.lit("niqe"), F.lit(2.0)), lambda k, v: v.isNotNull()))).select("path", F.try_element_at("m", F.lit("blur")).alias("blur"), F.try_element_at("m", F.lit("niqe")).alias("niqe"))
)
query("sk3_propagate_columns", f"WITH {MEDIA} SELECT path, source, false AS has_metrics, has_classes FROM media")(
    lambda spark, d: select.propagate(catalog.media(spark, d), "format").select("path", "source", F.col("metrics").isNotNull().alias("has_metrics"), F.col("classes").isNotNull().alias("has_classes"))
)
query("sk6_cluster_manifest", "SELECT label, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS rank FROM embeddings WHERE label >= 0 GROUP BY label")(
    lambda spark, d: report.cluster_ranks(catalog.read(spark, d, "embeddings")).where("label >= 0").select("label", F.col("n").alias("size"), F.col("rank").cast("long").alias("rank"))
)
_BY_SIZE = "short AS (SELECT path, bucket, 'size_' || file_size || '.jpg' AS name FROM media)"


def _by_size(spark: SparkSession, d: str) -> DataFrame:
    """All media under names that collide: their sizes."""
    return catalog.media(spark, d).withColumn("name", F.concat(F.lit("size_"), F.col("file_size").cast("string"), F.lit(".jpg")))


query("sk8_skip_existing", f"WITH {MEDIA}, {_BY_SIZE}, f AS (SELECT name, min(path) AS path FROM short GROUP BY name) SELECT path, name FROM f WHERE name NOT IN (SELECT name FROM short WHERE bucket = 'b0')")(
    lambda spark, d: select.not_at_destination(_by_size(spark, d), _by_size(spark, d).where("bucket = 'b0'")).select("path", "name")
)
query("sk9_undo_dedup", f"WITH {MEDIA}, {_BY_SIZE} SELECT path, name FROM short WHERE bucket = 'b2' AND name NOT IN (SELECT name FROM short WHERE bucket = 'b0')")(
    lambda spark, d: select.restorable(_by_size(spark, d).where("bucket = 'b2'"), _by_size(spark, d).where("bucket = 'b0'")).select("path", "name")
)

# Search hits

_FIELDS = ["url", "engine", "width", "height", "license", "title", "author"]
query(
    "ag1_richest_hits",
    f"""WITH {HITS}, n AS (SELECT *, (engine IS NOT NULL)::INT + (width IS NOT NULL)::INT + (height IS NOT NULL)::INT + (license IS NOT NULL)::INT + (title IS NOT NULL)::INT + (author IS NOT NULL)::INT AS k FROM hits WHERE url <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY k DESC, ord) AS rn, min(ord) OVER (PARTITION BY url) AS first_ord FROM n) SELECT url, engine, title, ord, first_ord FROM r WHERE rn = 1""",
)(lambda spark, d: hits.richest_hits(catalog.hits(spark, d), _FIELDS).select("url", "engine", "title", "ord", "first_ord"))
query("ag2_search_summary", f"WITH {HITS} SELECT engine, count(*) AS raw, count(DISTINCT nullif(url, '')) AS urls FROM hits GROUP BY engine")(
    lambda spark, d: catalog.hits(spark, d).groupBy("engine").agg(F.count("*").alias("raw"), F.count_distinct(F.nullif("url", F.lit(""))).alias("urls"))
)
query("ag10_status_counts", "SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")(lambda spark, d: catalog.read(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n")))
query("ag11_url_set", f"WITH {HITS} SELECT DISTINCT url FROM hits WHERE url <> ''")(lambda spark, d: catalog.hits(spark, d).where("url <> ''").select("url").distinct())
query("jn2_last_provenance", f"WITH {HITS} SELECT url, arg_max(engine, ord) AS engine FROM hits WHERE url <> '' GROUP BY url")(
    lambda spark, d: catalog.hits(spark, d).where("url <> ''").groupBy("url").agg(F.max_by("engine", "ord").alias("engine"))
)
query(
    "jn5_fn21_query_matrix",
    """WITH s(s, suffix) AS (VALUES (1, 'photo'), (2, ''), (3, 'portrait')) SELECT 0 AS part, n_nationkey AS t, 0 AS s, n_name AS query FROM nation UNION ALL SELECT 1, n_nationkey, s, n_name || ' ' || suffix FROM nation, s WHERE suffix <> ''""",
)(
    lambda spark, d: hits.query_matrix(catalog.read(spark, d, "nation").select(F.col("n_nationkey").alias("t"), F.col("n_name").alias("term")), spark.createDataFrame([(1, "photo"), (2, ""), (3, "portrait")], "s int, suffix string"))
)
query(
    "op_cb_circuit_breaker",
    """WITH r AS (SELECT user_id AS domain, ts, event_id, event_type <> 'error' AS ok FROM events), g AS (SELECT *, sum(ok::INT) OVER (PARTITION BY domain ORDER BY ts, event_id) AS run FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY domain, run ORDER BY ts, event_id) AS k FROM g WHERE NOT ok) SELECT domain, min(ts) AS tripped_at FROM k WHERE k >= 3 GROUP BY domain""",
)(lambda spark, d: hits.tripped(catalog.requests(spark, d), 3))
query("op_cb_stream", ORACLES["op_cb_circuit_breaker"])(lambda spark, d: _breaker_stream(spark, d))
query("op_cls_status_accounting", "SELECT count(*) FILTER (event_type = 'click') AS downloaded, count(*) FILTER (event_type = 'error') AS failed, count(DISTINCT user_id) FILTER (event_type = 'error') AS limited FROM events")(
    lambda spark, d: catalog.read(spark, d, "events").agg(F.count_if(F.col("event_type") == "click").alias("downloaded"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_distinct(F.when(F.col("event_type") == "error", F.col("user_id"))).alias("limited"))
)

# Duplicates

_DISTINCT = f"{MEDIA}, h AS (SELECT phash, min(path) AS p, count(*) AS n FROM media WHERE phash IS NOT NULL AND width IS NOT NULL GROUP BY phash)"
_BITS = "('0x' || substr({0}, 1, 8))::UINTEGER"
_XOR = "bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo))"
_HASHED = f"{_DISTINCT}, x AS (SELECT *, CAST('0x' || substr(phash, 1, 8) AS BIGINT) AS hi, CAST('0x' || substr(phash, 9, 8) AS BIGINT) AS lo FROM h), e AS (SELECT a.phash AS a, b.phash AS b, CAST({_XOR} AS INT) AS distance FROM x a JOIN x b ON a.phash < b.phash AND {_XOR} <= 8)"


def _hashes(spark: SparkSession, d: str) -> DataFrame:
    return catalog.media(spark, d).where("phash IS NOT NULL AND width IS NOT NULL").select(F.col("phash").alias("id")).distinct().select("id", *dedup.halves("id"))


query("jn3_fn6_hamming_pairs", f"WITH {_HASHED} SELECT a, b, distance FROM e")(lambda spark, d: dedup.hamming_pairs(_hashes(spark, d)))
_COMPONENTS = f"{_HASHED}, both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), walk AS (SELECT phash AS node, phash AS reach FROM h UNION SELECT w.node, t.b FROM walk w JOIN both_ways t ON t.a = w.reach), comp AS (SELECT node, min(reach) AS label FROM walk GROUP BY node), g AS (SELECT c.label, sum(h.n) AS members, min(h.p) AS grp FROM comp c JOIN h ON h.phash = c.node GROUP BY c.label HAVING sum(h.n) > 1)"
query("ag3_duplicate_components", f"WITH RECURSIVE {_COMPONENTS} SELECT m.path, g.grp, CAST(g.members AS BIGINT) AS members FROM media m JOIN comp c ON c.node = m.phash JOIN g USING (label) WHERE m.width IS NOT NULL")(
    lambda spark, d: dedup.duplicate_groups(_shared(spark, catalog.media(spark, d))).select("path", "grp", "members")
)
_WINNERS = f"{_COMPONENTS}, r AS (SELECT m.path, g.grp, row_number() OVER (PARTITION BY g.grp ORDER BY (NOT m.upscale)::INT DESC, m.width::BIGINT * m.height DESC, m.file_size DESC, coalesce(m.blur, 0) DESC, m.path) = 1 AS winner FROM media m JOIN comp c ON c.node = m.phash JOIN g USING (label) WHERE m.width IS NOT NULL)"
query("ag4_dedup_winners", f"WITH RECURSIVE {_WINNERS} SELECT path, grp, winner FROM r")(lambda spark, d: dedup.winners(dedup.duplicate_groups(_shared(spark, catalog.media(spark, d)))).select("path", "grp", "winner"))
query("ag5_dedup_summary", f"WITH RECURSIVE {_WINNERS} SELECT count(DISTINCT grp) AS groups, count(*) FILTER (winner) AS kept, count(*) FILTER (NOT winner) AS losers, CASE WHEN count(*) = 0 THEN 'noop' ELSE 'dedup' END AS mode FROM r")(
    lambda spark, d: dedup.summary(dedup.winners(dedup.duplicate_groups(_shared(spark, catalog.media(spark, d)))), 2)
)

# Reports and detections

query(
    "ag6_validate",
    f"WITH {MEDIA} SELECT count(*) AS total, count(*) FILTER (width IS NULL) AS failed, count(DISTINCT (width || 'x' || height)) AS dims, count(DISTINCT CASE WHEN width IS NOT NULL THEN mode END) AS modes, count(*) FILTER (width <> height) AS non_square, false AS passed FROM media",
)(lambda spark, d: report.validate(catalog.media(spark, d), True))
query("ag6_size_counts", f"WITH {MEDIA} SELECT width, height, count(*) AS n FROM media WHERE width IS NOT NULL GROUP BY width, height")(
    lambda spark, d: catalog.media(spark, d).where("width IS NOT NULL").groupBy("width", "height").agg(F.count("*").alias("n"))
)
query(
    "ag7_cluster_ranks",
    "WITH s AS (SELECT label % 7 - 1 AS label, count(*) AS n FROM embeddings GROUP BY 1), r AS (SELECT label, n, CASE WHEN label >= 0 THEN CAST(row_number() OVER (PARTITION BY label >= 0 ORDER BY n DESC, label) - 1 AS INT) END AS rank FROM s) SELECT *, CASE WHEN rank < 3 THEN lpad(CAST(rank AS VARCHAR), 3, '0') ELSE 'noise' END AS folder FROM r",
)(lambda spark, d: report.cluster_ranks(catalog.read(spark, d, "embeddings").select((F.col("label") % 7 - 1).alias("label")), 3))
query("ag8_class_counts", f"WITH {MEDIA} SELECT 'face' AS class, count(face) AS images FROM media UNION ALL SELECT 'cat', count(cat) FROM media")(lambda spark, d: detections.class_counts(catalog.media(spark, d)))
query(
    "ag9_top_instances",
    f"WITH {DETECTIONS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY image, class ORDER BY score DESC, {ORD}) AS INT) AS k FROM detections) SELECT image, lower(class) AS class, k, score, CAST(x0 AS VARCHAR) || ',' || y0 || ',' || x1 || ',' || y1 AS box FROM r WHERE k <= 2",
)(lambda spark, d: detections.top_instances(catalog.detections(spark, d), 2).withColumn("box", F.array_join("box", ",")))
_CROP = f"""{DETECTIONS}, c AS (SELECT *, greatest(x1 - x0, y1 - y0)::DOUBLE AS side, (x0 + x1) / 2.0 AS mx, (y0 + y1) / 2.0 AS my, count(*) OVER (PARTITION BY image, class) > 1 AS several FROM detections WHERE score >= 0.1),
q AS (SELECT *, mx - side / 2 - side * 0.1 AS ex0, my - side / 2 - side * 0.1 AS ey0, mx + side / 2 + side * 0.1 AS ex1, my + side / 2 + side * 0.1 AS ey1 FROM c),
s AS (SELECT *, least(CAST(round_even(ex1 - ex0, 0) AS INT), 640, 480) AS px FROM q), p AS (SELECT *, greatest(0, least(CAST(trunc(ex0) AS INT), 640 - px)) AS cx0, greatest(0, least(CAST(trunc(ey0) AS INT), 480 - px)) AS cy0 FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY image, class ORDER BY score DESC, {ORD}) - 1 AS number FROM p WHERE px > 0)"""
query("px4_fn12_fn15_crops", f"WITH {_CROP} SELECT image, lower(class) AS class, cx0, cy0, cx0 + px AS cx1, cy0 + px AS cy1, CASE WHEN several THEN image || '_' || lower(class) || '_' || printf('%02d', number) || '.jpg' ELSE image || '_' || lower(class) || '.jpg' END AS crop FROM n")(
    lambda spark, d: detections.crops(catalog.detections(spark, d), 640, 480, 0.1, True, 0.1).select("image", F.lower("class").alias("class"), "cx0", "cy0", "cx1", "cy1", "crop")
)
query("fn11_scale_boxes", f"WITH {MEDIA} SELECT path, CASE WHEN face IS NOT NULL THEN '0,0,15,15' END AS face, CASE WHEN cat IS NOT NULL THEN '1,1,7,7' END AS cat FROM media")(
    lambda spark, d: catalog.media(spark, d).withColumn("s", geometry.scale_classes(F.col("classes"), 1.5)).select("path", *[F.array_join(F.try_element_at(F.try_element_at("s", F.lit(c)), F.lit(1))["box"], ",").alias(c) for c in ("face", "cat")])
)
query("fn14_shift_boxes", f"WITH {MEDIA} SELECT path, CASE WHEN face IS NOT NULL THEN '0,0,4,6' END AS face FROM media")(
    lambda spark, d: catalog.media(spark, d).withColumn("s", geometry.shift_classes(F.col("classes"), F.lit(3), F.lit(4), F.lit(4), F.lit(8))).select("path", F.array_join(F.try_element_at(F.try_element_at("s", F.lit("face")), F.lit(1))["box"], ",").alias("face"))
)
for _mode, _pick in (("crop", "greatest"), ("pad", "least")):
    query(
        f"px2_fn17_fn18_frame_{_mode}",
        f"""WITH {MEDIA}, s AS (SELECT path, greatest({512 if _mode == 'crop' else 1}, CAST(round_even(width * {_pick}(512.0::DOUBLE / width, 384.0::DOUBLE / height), 0) AS INT)) AS scaled_w,
greatest({384 if _mode == 'crop' else 1}, CAST(round_even(height * {_pick}(512.0::DOUBLE / width, 384.0::DOUBLE / height), 0) AS INT)) AS scaled_h FROM media WHERE width IS NOT NULL)
SELECT *, CAST(round_even((512 - scaled_w) * 0.5::DOUBLE, 0) AS INT) AS off_x, CAST(round_even((384 - scaled_h) * 0.5::DOUBLE, 0) AS INT) AS off_y FROM s""",
    )(lambda spark, d, mode=_mode: catalog.media(spark, d).where("width IS NOT NULL").select("path", *[c.alias(n) for n, c in geometry.frame_geometry(F.col("width"), F.col("height"), 512, 384, mode).items()]))
query("px7_tile_grid", f"WITH {MEDIA} SELECT path, x AS x0, y AS y0, least(x + 512, width) AS x1, least(y + 512, height) AS y1, greatest(x - 32, 0) AS in_x0, greatest(y - 32, 0) AS in_y0, least(x + 544, width) AS in_x1, least(y + 544, height) AS in_y1 FROM (SELECT path, width, height, unnest(generate_series(0, width - 1, 512)) AS x FROM media WHERE width IS NOT NULL), (SELECT unnest(generate_series(0, 4000, 512)) AS y) WHERE y < height")(
    lambda spark, d: catalog.media(spark, d).where("width IS NOT NULL").select("path", F.explode(geometry.tile_grid(F.col("width"), F.col("height"))).alias("t")).select("path", "t.*")
)
query(
    "px1_augment",
    f"WITH {MEDIA}, f(flip) AS (VALUES (''), ('X'), ('Y'), ('XY')) SELECT path, flip, CASE WHEN flip = '' THEN name ELSE replace(name, '.jpg', '_flip' || flip || '.jpg') END AS new_name FROM media, f",
)(lambda spark, d: report.augmented(catalog.media(spark, d)))
query("px3_format_names", f"WITH {MEDIA} SELECT path, replace(name, '.jpg', '.webp') AS new_name, false AS clash FROM media")(lambda spark, d: report.reformatted(catalog.media(spark, d), ".webp").select("path", "new_name", "clash"))
query(
    "px6_key_frames",
    """WITH RECURSIVE t AS (SELECT DISTINCT user_id AS video, CAST(floor(epoch(ts)) AS DOUBLE) AS t FROM events), k AS (SELECT video, min(t) AS t FROM t GROUP BY video UNION ALL SELECT k.video, (SELECT min(t.t) FROM t WHERE t.video = k.video AND t.t >= k.t + 86400) FROM k WHERE k.t IS NOT NULL) SELECT video, t FROM k WHERE t IS NOT NULL""",
)(lambda spark, d: report.greedy_frames(catalog.read(spark, d, "events").select(F.col("user_id").alias("video"), F.expr("floor(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', CAST(ts AS timestamp_ntz)) / 1e6)").cast("double").alias("t")), 86400.0))
query("px9_l2_norm", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS squared, round(1.0::DOUBLE, 6) AS normed FROM embeddings")(
    lambda spark, d: catalog.read(spark, d, "embeddings").select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 6).alias("squared"), F.round(F.aggregate(report.l2_normalized(F.col("embedding")), F.lit(0.0), lambda s, x: s + x * x), 6).alias("normed"))
)

# Scalar functions

_PAGE = "page_urls AS (SELECT page_id, split_part(url, '#', 1) || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'w=100&keep=1' AS url FROM pages)"


def _page_urls(spark: SparkSession, d: str) -> DataFrame:
    return catalog.read(spark, d, "pages").select("page_id", F.concat(F.split_part("url", F.lit("#"), F.lit(1)), F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("w=100&keep=1")).alias("url"))


query("fn1_clean_url", f"WITH {_PAGE} SELECT page_id, replace(url, 'w=100&', '') AS url FROM page_urls")(lambda spark, d: _page_urls(spark, d).select("page_id", urls.clean_url(F.col("url")).alias("url")))
query("fn1_clean_url_exact", f"WITH {_PAGE} SELECT page_id, replace(url, 'w=100&', '') AS url FROM page_urls")(lambda spark, d: _page_urls(spark, d).select("page_id", urls.clean_url_exact(F.col("url")).alias("url")))
query("fn2_canonical_url", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://a.example/' || page_id WHEN page_id % 3 = 1 THEN 'https://p.example/?url=ftp%3A%2F%2Fx' ELSE url END AS url FROM pages")(
    lambda spark, d: catalog.read(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://p.example/?url=https%3A%2F%2Fa.example%2F"), F.col("page_id").cast("string"))).when(F.col("page_id") % 3 == 1, F.lit("https://p.example/?url=ftp%3A%2F%2Fx")).otherwise(F.col("url")).alias("url")).select("page_id", urls.canonical_url(F.col("url")).alias("url"))
)
query("fn3_fn4_suffix_and_key", "SELECT page_id, coalesce(lower(regexp_extract(regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^[a-z]+://[^/]*', ''), '(\\.[^./]+)$', 1)), '') AS suffix, md5(url) AS content_key FROM pages")(
    lambda spark, d: catalog.read(spark, d, "pages").select("page_id", urls.suffix(F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))).alias("suffix"), urls.content_key(F.col("url")).alias("content_key"))
)
query("fn5_extension", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.mp4' END AS ext FROM pages")(
    lambda spark, d: catalog.read(spark, d, "pages").select("page_id", urls.extension_of(F.element_at(F.array(F.lit("image/JPEG; q=1"), F.lit(" image/png"), F.lit("video/x-any"), F.lit("text/html")), (F.col("page_id") % 4 + 1).cast("int")), F.lit("https://x.example/a"), catalog.VIDEO_SUFFIXES).alias("ext"))
)
query("fn20_hex_colour", "SELECT page_id, CAST('0x' || substr(md5(url), 1, 2) AS INT) AS r, CAST('0x' || substr(md5(url), 3, 2) AS INT) AS g, CAST('0x' || substr(md5(url), 5, 2) AS INT) AS b FROM pages")(
    lambda spark, d: catalog.read(spark, d, "pages").select("page_id", *[geometry.hex_channel(F.concat(F.lit("#"), F.substring(F.md5("url"), 1, 6)), k).alias(n) for k, n in enumerate("rgb")])
)
query("fn22_strip_html", "SELECT page_id, length(trim(regexp_replace(html, '<[^>]+>', '', 'g'), ' ')) AS n FROM pages")(
    lambda spark, d: catalog.read(spark, d, "pages").select("page_id", F.length(F.trim(F.regexp_replace("html", "<[^>]+>", ""))).cast("long").alias("n"))
)
query("fn24_cache_key", f"WITH {MEDIA} SELECT bucket, sha256('clip' || string_agg(path, '' ORDER BY path)) AS cache_key FROM media GROUP BY bucket")(
    lambda spark, d: catalog.media(spark, d).groupBy("bucket").agg(F.sha2(F.concat(F.lit("clip"), F.array_join(F.sort_array(F.collect_list("path")), "")), 256).alias("cache_key"))
)
#: Licence numbers of one engine.
_LICENSES = {"0": "all-rights-reserved", "1": "cc-by-nc-sa-2.0", "2": "cc-by-nc-2.0", "3": "cc-by-nc-nd-2.0", "4": "cc-by-2.0", "5": "cc-by-sa-2.0", "6": "cc-by-nd-2.0", "7": "no-known-restrictions", "8": "us-government-work", "9": "cc0-1.0", "10": "public-domain-mark"}
query("fn26_license_decode", "SELECT page_id, CASE page_id % 13 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _LICENSES.items()) + " END AS license FROM pages")(
    lambda spark, d: catalog.read(spark, d, "pages").select("page_id", F.try_element_at(F.create_map(*[F.lit(x) for kv in _LICENSES.items() for x in kv]), (F.col("page_id") % 13).cast("string")).alias("license"))
)

# Engine answers

from ..sources import engines  # noqa: E402

_ANSWERS = {
    "sc10_brave": "SELECT page_id, url, 'brave' AS engine, CAST(800 + page_id AS INT) AS width, CAST(600 AS INT) AS height, 't' || page_id AS title FROM pages WHERE NOT greatest(800 + page_id, 600) < 900",
    "sc11_flickr": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE url || '_k' END AS url, 'flickr' AS engine, CAST(1024 AS INT) AS width, CAST(768 AS INT) AS height, 't' || page_id AS title FROM pages",
    "sc12_inaturalist": "SELECT page_id, 'https://i.example/' || page_id || '/original.jpg' AS url, 'inaturalist' AS engine, CAST(NULL AS INT) AS width, CAST(NULL AS INT) AS height, CASE WHEN page_id % 2 = 0 THEN 'oak' ELSE 'Quercus' END AS title FROM pages",
    "sc13_serper": "SELECT page_id, url, 'serper' AS engine, CAST(900 AS INT) AS width, CAST(700 AS INT) AS height, 't' || page_id AS title FROM pages",
    "sc14_wikimedia": "SELECT page_id, url, 'wikimedia' AS engine, CAST(1200 AS INT) AS width, CAST(900 AS INT) AS height, 'A' || page_id || '.jpg' AS title FROM pages WHERE page_id % 4 <> 0",
}
for _name, _sql in _ANSWERS.items():
    query(_name, _sql)(lambda spark, d, engine=_name.split("_")[1]: engines.parse(engines.sample_answers(catalog.read(spark, d, "pages"), engine), engine, 900).select("page_id", "url", "engine", "width", "height", "title"))
query(
    "jn6_core_distance",
    "WITH p AS (SELECT a.vec_id, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY d) AS k FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) SELECT vec_id, round(d, 4) AS core FROM p WHERE k = 2",
)(lambda spark, d: _core(spark, d))


def _core(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.vectors import core_distances

    return core_distances(catalog.read(spark, d, "embeddings").select("vec_id", "embedding"), 2).select("vec_id", F.round("core", 4).alias("core"))


@query("px10_cluster")
def _cluster(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.vectors import hdbscan

    return hdbscan(catalog.read(spark, d, "embeddings").select("vec_id", "embedding"), 5, 2)


def _breaker_stream(spark: SparkSession, d: str) -> DataFrame:
    """The breaker over the events as a stream, run until all that is there has been read."""
    from ..operators.storage import fresh_path
    from ..streaming.hits import run_available
    from ..streaming.requests import tripped_stream

    events = spark.readStream.schema(catalog.read(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    out = fresh_path(spark, "breaker")
    run_available(tripped_stream(catalog.as_requests(events), 3), out, fresh_path(spark, "breaker-state"))
    return spark.read.schema("domain long, tripped_at timestamp").parquet(out)
