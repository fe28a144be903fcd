"""The batch pipeline: preprocess, detect, segment, judge, report. Every stage is a function from DataFrame to
DataFrame; the two that ask outside models are to be written before they are read twice."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import keep, output_file, verdict
from ..operators import boxes, glyphs
from ..operators import kernels as K
from ..operators.arrow import each_raster, map_raster, try_raster
from ..schema import CHARS
from ..services import ask
from ..sources.images import to_array
from ..sources.sinks import with_png


def preprocess_kernel(how: Settings, heal: bool | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """Gray, healed once if asked, equalised, stretched, ink kept: one fused kernel."""

    def run(x: np.ndarray) -> np.ndarray:
        x = K.gray(x)
        if how.heal.enabled if heal is None else heal:
            x = K.heal(x, how.heal.kernel, how.heal.iterations, how.heal.directions, how.heal.bilateral)
        c = how.contrast
        x = K.contrast(K.clahe(x, c.clahe_clip, c.clahe_tiles), c.alpha, c.beta)
        return K.keep_ink(x, how.ink.blackhat_kernel, how.ink.strength, how.ink.unsharp) if how.ink.enabled else x

    return run


def preprocess(images: DataFrame, how: Settings, heal: bool | None = None) -> DataFrame:
    return map_raster(images, preprocess_kernel(how, heal))


def preprocess_errors(images: DataFrame, how: Settings, heal: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Preprocessed rasters, and (image_id, error) of those that failed; one bad raster does not end the batch."""
    tried = try_raster(images, preprocess_kernel(how, heal))
    return tried.where("error is null").drop("error"), tried.where("error is not null").select("image_id", "error")


def heal_debug(images: DataFrame, how: Settings) -> DataFrame:
    """What healing changes: (image_id, added pixels in parts of six or more, largest difference)."""
    plain, healed = preprocess_kernel(how, False), preprocess_kernel(how, True)

    def rows(key, x):
        a, b = plain(x), healed(x)
        labels, stats = K.components((K.ink_otsu(a) == 0) & (K.ink_otsu(b) > 0))
        large = K.select(labels, stats[:, 4] >= 6) if len(stats) else np.zeros_like(a)
        yield key, int((large > 0).sum()), int(np.abs(a.astype(int) - b).max())

    return each_raster(images, rows, "image_id string, added_pixels int, largest_change int")


RESPONSE = "struct<success:boolean,message:string,total_time:double,text_regions:array<struct<bbox:array<double>,rect:array<double>,box:array<double>,text:string,confidence:double>>>"


def detect(images: DataFrame, detector: Callable[[str, bytes], str], workers: int = 4) -> DataFrame:
    """Region rows by a page detector; a failed image is one whole-image region."""
    asked = with_png(images).withColumnRenamed("image_id", "key")
    replies = ask(asked, detector, workers=workers).withColumnRenamed("key", "image_id")
    sized = images.select("image_id", "width", "height").join(replies, "image_id", "left")
    parsed = sized.withColumn("r", F.from_json("raw", RESPONSE))
    ok = F.coalesce(F.col("r.success") & F.col("error").isNull(), F.lit(False))
    return boxes.regions_of(parsed.select("image_id", "width", "height", ok.alias("ok"), F.col("r.text_regions").alias("text_regions")))


def crop_regions(images: DataFrame, regions: DataFrame) -> DataFrame:
    """Raster rows of the regions, without loss; their id is image:region."""
    lists = regions.groupBy("image_id").agg(F.collect_list(F.struct("region_id", "x1", "y1", "x2", "y2")).alias("boxes"))
    joined = images.join(lists, "image_id")
    return _with_boxes(joined, lambda key, x, found: [(f"{key}:{k}", y2 - y1, x2 - x1, 1 if x.ndim == 2 else 3, np.ascontiguousarray(x[y1:y2, x1:x2]).tobytes()) for k, x1, y1, x2, y2 in found], "image_id string, height int, width int, n_channels int, data binary")


def _with_boxes(joined: DataFrame, rows: Callable, schema: str) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    from ..operators.arrow import _schema

    arrow = to_arrow_schema(_schema(schema))

    def run(batches):
        for batch in batches:
            get = {n: batch.column(n).to_pylist() for n in ("image_id", "height", "width", "n_channels", "data", "boxes")}
            out = [r for key, h, w, n, data, found in zip(*get.values(), strict=True) for r in rows(key, to_array(data, h, w, n), [tuple(b.values()) for b in found])]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [()] * len(arrow), arrow, strict=True)], names=arrow.names)

    return joined.select("image_id", "height", "width", "n_channels", "data", "boxes").mapInArrow(run, schema)


def segment(regions: DataFrame, detected: DataFrame, how: Settings) -> DataFrame:
    """Refined, cleaned character crops of region rasters; `detected` has image_id, region_id, det_idx, text,
    confidence and nbox (normalised, origin at the bottom left)."""
    sized = detected.join(regions.select("image_id", "width", "height"), "image_id")
    chars = boxes.detected_chars(sized)
    lists = chars.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "char_order", "filename", "w", "h", "text", "confidence", "region_id"))).alias("boxes"))

    def rows(key, x, found):
        for y, left, order, name, w, h, text, confidence, region in found:
            refined = glyphs.refine(x, (left, y, w, h), how)
            if refined:
                box, crop = refined
                yield key, region, order, name, *box, text, confidence, crop.shape[0], crop.shape[1], 1, np.ascontiguousarray(crop).tobytes()

    return _with_boxes(regions.join(lists, "image_id"), rows, CHARS)


DEBUG = "image_id string, char_order int, noise_parts int, parts int, removed_parts int, trim array<int>, border array<int>, spikes array<struct<start:int,end:int,mean:double,after:double,drop:double,border:boolean>>"


def segment_debug(regions: DataFrame, detected: DataFrame, how: Settings) -> DataFrame:
    """The numbers behind each refined box, as `refine` itself met them: parts painted over and removed, both trims,
    and the left margin's runs. Boxes of which nothing is left have no row."""
    sized = detected.join(regions.select("image_id", "width", "height"), "image_id")
    lists = boxes.detected_chars(sized).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("char_order", "x", "y", "w", "h"))).alias("boxes"))

    def rows(key, x, found):
        for order, left, top, w, h in found:
            trace: dict = {}
            if glyphs.refine(x, (left, top, w, h), how, trace):
                yield key, order, trace["noise_parts"], trace["parts"], trace["removed_parts"], [int(v) for v in trace["trim"]], [int(v) for v in trace["border"]], trace["spikes"]

    return _with_boxes(regions.join(lists, "image_id"), rows, DEBUG)


def segment_overlay(regions: DataFrame, chars: DataFrame) -> DataFrame:
    """Each region beside a white page with its crops at their refined places."""
    lists = chars.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("char_order", "x", "y", "w", "h", F.col("height").alias("ch"), F.col("width").alias("cw"), "data"))).alias("boxes"))

    def rows(key, x, found):
        crops = [np.frombuffer(data, np.uint8).reshape(h, w) for *_, h, w, data in found]
        out = np.ascontiguousarray(glyphs.overlay(x, [tuple(b[1:5]) for b in found], crops))
        yield key, out.shape[0], out.shape[1], 3, out.tobytes()

    return _with_boxes(regions.join(lists, "image_id"), rows, "image_id string, height int, width int, n_channels int, data binary")


def segment_summary(chars: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Characters of each region, and the length of the text that was expected there."""
    out = chars.groupBy("image_id", "region_id").agg(F.count("*").alias("character_count"), F.array_sort(F.collect_list(F.struct("y", "x", "filename", "text"))).alias("characters"))
    return out if expected is None else out.join(expected.select("image_id", F.length("expected").alias("expected_text_len")), "image_id", "left")


def judge(chars: DataFrame, call: Callable[[str, bytes], str] | None, how: Settings) -> DataFrame:
    """A verdict for each character: accepted, filtered_out or error, and the name it goes by. Without a judge no
    character is known, so all are filtered out. The index is the file's place in its folder."""
    from pyspark.sql import Window

    index = F.row_number().over(Window.partitionBy("image_id", "region_id").orderBy("filename"))
    named = chars.withColumns({"k": index, "key": F.concat_ws("/", "image_id", F.col("region_id").cast("string"), "filename")})
    if call is None or not how.judge.enabled:
        replies = named.select("key", F.lit(None).cast("string").alias("raw"), F.lit(None).cast("double").alias("response_time"), F.lit(None).cast("string").alias("error"))
    else:
        replies = ask(with_png(named), call, workers=how.judge.workers, retries=how.judge.retries)
    told = named.select("key", "image_id", "region_id", "filename", "k").join(replies, "key").withColumn("v", verdict(F.col("raw")))
    failed = F.col("error").isNotNull() | F.coalesce(F.col("v.error"), F.lit(False))
    kept = keep(F.col("v")) & ~failed
    status = F.when(failed, "error").when(kept, "accepted").otherwise("filtered_out")
    return told.select("image_id", "region_id", "filename", status.alias("status"), F.when(~failed, output_file(F.col("k"), F.col("v.character"), kept)).alias("output_file"), F.col("v").alias("evaluation"), "response_time", "error", F.lit(how.digest()).alias("settings"))


def report(verdicts: DataFrame) -> DataFrame:
    """Counters of each region and, with a null region and image, of the batch."""
    count = lambda s: F.count_if(F.col("status") == s)
    return verdicts.rollup("image_id", "region_id").agg(F.count("*").alias("total_files"), count("accepted").alias("accepted"), count("filtered_out").alias("filtered_out"), count("error").alias("error")).where("region_id is not null or image_id is null")


STAGES = ("preprocess", "preocr", "segment", "postocr")


def run_pipeline(images: DataFrame, how: Settings, stages: tuple[str, ...] = ("preprocess", "segment", "postocr"), detector=None, characters: Callable[[DataFrame], DataFrame] | None = None, judge_call=None, write: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> dict[str, DataFrame]:
    """The named stages in their fixed order. `characters` gives the detected characters of region rasters; `write`
    stores what must not be asked twice. Without preocr every image is one region."""
    how.check()
    unknown = [s for s in stages if s not in STAGES]
    if unknown:
        raise ValueError(f"unknown stage: {unknown[0]}")
    out: dict[str, DataFrame] = {}
    if "preprocess" in stages:
        images = out["preprocess"] = preprocess(images, how)
    regions = images
    if "preocr" in stages:
        out["preocr"] = write(detect(images, detector), "regions")
        regions = crop_regions(images, out["preocr"])
    if "segment" in stages:
        out["segment"] = write(segment(regions, write(characters(regions), "detected"), how), "chars")
    if "postocr" in stages:
        out["postocr"] = write(judge(out["segment"], judge_call, how), "verdicts")
        out["report"] = report(out["postocr"])
    return out
