"""The seventeen commands as functions of DataFrames.

A command returns a DataFrame and writes nothing: what it would do is the plan, and a sink (`sources.sinks`, a writer)
carries it out.  Commands that need pixels take Spark's image column; those that need a model or decoder
take the factory of one (`operators.models`) and raise without it.  Wrong arguments raise InputError before
anything runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, pixels
from ..operators import acquire, dedup as _dedup, detections, hits as _hits, models, report, select as _select, vectors as _vectors
from ..operators.storage import written
from ..sources.files import InputError

#: What the commands accept.
METRICS, FORMATS, CHANNELS, SCALES = ("phash", "blur"), ("jpg", "png", "webp"), ("rgb", "grayscale"), (2, 4)
MODES = ("stretch", "crop", "pad")


class PipelineError(RuntimeError):
    """Nothing usable came out."""


def _one_of(value, allowed: Iterable, what: str) -> None:
    if value not in allowed:
        raise InputError(f"{what} has to be one of {', '.join(map(str, allowed))}, not {value!r}")


def _pairs(values) -> list[tuple[str, float]]:
    return [(k, float(v)) for k, v in dict(values or {}).items()]


def search(spark: SparkSession, *, terms: list[str], suffixes: list[str] = (), suffix_only: bool = False) -> DataFrame:
    """(ord, query): what to ask an engine for; `sources.engines.SearchSource` asks."""
    if not terms or (suffix_only and not any(s.strip() for s in suffixes)):
        raise InputError("no search terms" if not terms else "suffixes are needed where bare terms are left out")
    t = spark.createDataFrame([(k, x) for k, x in enumerate(terms)], "t int, term string")
    s = spark.createDataFrame([(k, x) for k, x in enumerate(suffixes)], "s int, suffix string")
    return _hits.query_matrix(t, s, suffix_only)


def fetch(hits: DataFrame, *, min_size: int | None = 512, license_filter: list[str] | None = None) -> DataFrame:
    """The download plan of the hits that are large enough, allowed and supported; one row an address."""
    wanted = _hits.fetchable(hits, min_size, license_filter).where("NOT unsupported")
    return acquire.download_plan(wanted.select("url").distinct())


def analyze(media: DataFrame, *, metrics: Iterable[str] = METRICS, force: bool = False, clear: bool = False) -> DataFrame:
    """``phash`` and the metric ``blur`` of items (column image) that lack them, or of all if forced; cleared items start anew."""
    for name in metrics:
        _one_of(name, METRICS, "metric")
    image, have = F.col("image"), F.coalesce("metrics", F.create_map().cast("map<string,double>"))
    if clear:
        media = media.withColumns({"metrics": F.create_map().cast("map<string,double>"), "phash": F.lit(None).cast("string")})
    # Pixels are passed on only where there is something to compute.
    measured = lambda f, missing: f(F.when(F.lit(force) | missing, image["data"]), image["width"], image["height"], image["nChannels"])
    if "phash" in metrics:
        media = media.withColumn("phash", F.coalesce(measured(pixels.phash, F.col("phash").isNull()), "phash"))
    if "blur" in metrics:
        media = media.withColumn("_blur", measured(pixels.blur, ~F.map_contains_key(have, "blur")))
        media = media.withColumn("metrics", F.when(F.col("_blur").isNull(), F.col("metrics")).otherwise(_select.merge_metrics(F.col("metrics"), F.create_map(F.lit("blur"), F.col("_blur"))))).drop("_blur")
    return media


def annotate(media: DataFrame, *, source: str | None = None, license: str | None = None, origin: str | None = None, overwrite: bool = False) -> DataFrame:
    """Provenance where it is missing, or everywhere if overwritten."""
    values = {"source": source, "license": license, "origin": origin}
    if not any(values.values()):
        raise InputError("nothing to annotate")
    return _select.annotate(media, overwrite, **values).drop("changed")


def select(media: DataFrame, **options) -> DataFrame:
    """Items that pass all tests of `operators.select.Criteria`; metric and detection limits are mappings."""
    if "license_filter" in options:
        options["license"] = options.pop("license_filter")
    for name in ("min_metric", "max_metric", "min_detect", "max_detect"):
        options[name] = _pairs(options.get(name))
    try:
        criteria = _select.Criteria(**options)
    except TypeError as e:
        raise InputError(str(e)) from None
    return _select.select(media, criteria).where("reject_reason IS NULL").drop("reject_reason")


def dedup(media: DataFrame, *, threshold: int = _dedup.THRESHOLD, prefer_upscaled: bool = False) -> DataFrame:
    """Items without the losers of their near-duplicate groups."""
    losers = _dedup.winners(_dedup.duplicate_groups(media, threshold), prefer_upscaled).where("NOT winner").select("path")
    return media.join(losers, "path", "left_anti")


def rename(media: DataFrame, *, prefix: str = "", digits: int | None = None) -> DataFrame:
    """Items under numbered names."""
    return _select.rename(media, prefix, digits).withColumn("name", F.col("new_name")).drop("new_name", "number")


def validate(media: DataFrame, *, square: bool = False) -> DataFrame:
    """One row of counts and the verdict."""
    return report.validate(media, square)


def cluster(vectors: DataFrame, *, top: int | None = None, min_cluster_size: int = 5, min_samples: int = 2) -> DataFrame:
    """(vec_id, label, rank, folder); raises PipelineError where all is noise."""
    labels = written(_vectors.hdbscan(vectors, min_cluster_size, min_samples), "clusters")
    if labels.where("label >= 0").isEmpty():
        raise PipelineError("no cluster found")
    return labels.join(report.cluster_ranks(labels, top).drop("n"), "label").select("vec_id", "label", "rank", "folder")


def detect(items: DataFrame, *, factory: Callable | None, classes: list[str] | None = None, threshold: float = 0.2, max_instances: int = 1) -> DataFrame:
    """The best detections of each class and item, from a detector's backend."""
    raw = models.apply_model(items, "detect", factory).where(F.col("score") >= threshold)
    if classes:
        raw = raw.where(F.lower("class").isin([c.lower() for c in classes]))
    return detections.top_instances(raw.withColumnRenamed("path", "image").withColumn("ord", F.monotonically_increasing_id()), max_instances)


def extract_classes(
    raw: DataFrame, *, width: int, height: int, classes: list[str], margin: float = 0.0, square: bool = False, min_score: float = 0.0, skip_partial: bool = False
) -> DataFrame:
    """Crop windows and names of the detections (image, class, ord, score, box corners) of the classes."""
    if not classes or margin < 0:
        raise InputError("no classes" if not classes else "a margin cannot be negative")
    return detections.crops(raw.where(F.lower("class").isin([c.lower() for c in classes])), width, height, margin, square, min_score, skip_partial)


def extract_faces(items: DataFrame, *, factory: Callable | None, max_faces: int = 1) -> DataFrame:
    """Aligned faces from a landmark backend, at most ``max_faces`` an item."""
    return models.apply_model(items, "faces", factory).where(F.col("face") < max_faces)


def extract_frames(frames: DataFrame, *, keyframes: float = 10.0) -> DataFrame:
    """(video, t): the key frames to keep."""
    if keyframes <= 0:
        raise InputError("the interval has to be positive")
    return report.greedy_frames(frames, keyframes)


def augment(media: DataFrame, *, flip_x: bool = False, flip_y: bool = False, flip_xy: bool = False, no_copy: bool = False) -> DataFrame:
    """Originals (unless left out) and their flips under new names."""
    flips = tuple(f for f, wanted in (("X", flip_x), ("Y", flip_y), ("XY", flip_xy)) if wanted)
    if not flips:
        raise InputError("ask for at least one flip")
    return report.augmented(media, flips, not no_copy)


def format(media: DataFrame, *, fmt: str | None = None, channels: str | None = None) -> DataFrame:
    """New names, with ``clash`` and the channels asked for; `functions.render` makes the pixels."""
    if fmt is None and channels is None:
        raise InputError("ask for a format or channels")
    if channels is not None:
        _one_of(channels, CHANNELS, "channels")
    if fmt is None:
        return media.withColumns({"new_name": F.col("name"), "clash": F.lit(False), "channels": F.lit(channels)})
    _one_of(fmt, FORMATS, "format")
    return report.reformatted(media, f".{fmt}").withColumn("channels", F.lit(channels).cast("string"))


def frame(media: DataFrame, *, width: int | None = None, height: int | None = None, mode: str = "crop", gravity: str = "center", margin: str | int | None = None) -> DataFrame:
    """Size after scaling and place on the canvas; one side alone keeps the proportions."""
    _one_of(mode, MODES, "mode")
    _one_of(gravity, geometry.GRAVITY, "gravity")
    if width is None and height is None:
        raise InputError("ask for a width or a height")
    if margin is not None and (mode != "pad" or width is None or height is None):
        raise InputError("a margin needs padding to a width and a height")
    w, h = F.col("width"), F.col("height")
    if width is None or height is None:
        ratio = F.lit(float(width)) / w if width is not None else F.lit(float(height)) / h
        side = lambda given, own: F.lit(given) if given is not None else F.greatest(F.lit(1), F.bround(own * ratio).cast("int"))
        return media.withColumns({"scaled_w": side(width, w), "scaled_h": side(height, h), "off_x": F.lit(0), "off_y": F.lit(0)})
    try:
        space = geometry.resolve_margin(margin, width, height)
    except ValueError as e:
        raise InputError(str(e)) from None
    return media.withColumns(geometry.frame_geometry(w, h, width, height, mode, gravity, space))


def upscale(media: DataFrame, *, scale: int = 4, tile_size: int = 512, tile_pad: int = 32, denoise: float | None = None) -> DataFrame:
    """Items with their new size, the factor in ``upscale``, scaled detections, and the tiles a network reads."""
    _one_of(scale, SCALES, "scale")
    if denoise is not None and (scale != 4 or not 0 <= denoise <= 1):
        raise InputError("denoise is a share from 0 to 1, for a scale of 4")
    out = media.withColumn("tiles", geometry.tile_grid(F.col("width"), F.col("height"), tile_size, tile_pad))
    out = out.withColumns({"width": F.col("width") * scale, "height": F.col("height") * scale, "upscale": F.lit(scale)})
    return out.withColumn("classes", geometry.scale_classes(F.col("classes"), float(scale))) if "classes" in media.columns else out
