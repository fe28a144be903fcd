"""Box geometry and records of regions and characters, as column expressions and table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import char_file, region_file


def clamp(v: Column, low, high) -> Column:
    wrap = lambda c: c if isinstance(c, Column) else F.lit(c)
    return F.greatest(wrap(low), F.least(wrap(high), v))


def clamp_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> dict[str, Column]:
    """A box inside the image with at least one pixel."""
    a, b = clamp(x1, 0, width - 1), clamp(y1, 0, height - 1)
    return {"x1": a, "y1": b, "x2": clamp(x2, a + 1, width), "y2": clamp(y2, b + 1, height)}


def denormalise(nx: Column, ny: Column, nw: Column, nh: Column, width: Column, height: Column) -> dict[str, Column]:
    """Pixel x, y, w, h of a normalised box with its origin at the bottom left; halves round to even."""
    px = lambda c: F.bround(c).cast("int")
    x, y = clamp(px(nx * width), 0, width - 1), clamp(px((1.0 - ny - nh) * height), 0, height - 1)
    return {"x": x, "y": y, "w": clamp(px(nw * width), 1, width - x), "h": clamp(px(nh * height), 1, height - y)}


def expand(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, by=(2, 2, 4, 2)) -> dict[str, Column]:
    """Half-open corners, moved out by left, right, top, bottom and clamped."""
    left, right, top, bottom = by
    zero = F.lit(0)
    return {"x1": F.greatest(zero, x - left), "y1": F.greatest(zero, y - top), "x2": F.least(width, x + w + right), "y2": F.least(height, y + h + bottom)}


def polygon_box(points: Column) -> Column:
    """[x1, y1, x2, y2] of an array of [x, y]."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def flat_or_polygon_box(flat: Column, points: Column) -> Column:
    """A flat list counts by its first four numbers, even one of eight; else a polygon's box."""
    return F.when(F.size(flat) >= 4, F.slice(flat, 1, 4)).when(F.size(points) > 0, polygon_box(points))


def first_box(record: Column, *keys: str) -> Column:
    """The first of the names under which a detector may put its box."""
    return F.coalesce(*(record[k] for k in (keys or ("bbox", "rect", "box"))))


def polygon_area(points: Column) -> Column:
    """Shoelace over an array of (x, y)."""
    n = F.size(points)
    following = F.concat(F.slice(points, 2, n), F.slice(points, 1, 1))
    cross = F.zip_with(points, following, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0).cast("long"), lambda a, c: a + c)) / 2


def polygon_perimeter(points: Column) -> Column:
    following = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    sides = F.zip_with(points, following, lambda p, q: F.hypot((q["x"] - p["x"]).cast("double"), (q["y"] - p["y"]).cast("double")))
    return F.aggregate(sides, F.lit(0.0), lambda a, c: a + c)


def detected_chars(raw: DataFrame) -> DataFrame:
    """Characters of the detector's rows (text, confidence, nbox, width, height): others than four numbers go;
    `char_order` and the file name follow detection, the rows' order is for reading (y, x)."""
    good = raw.where((F.size("nbox") == 4) & F.col("text").isNotNull())
    n = [F.col("nbox")[k] for k in range(4)]
    return good.withColumns(denormalise(*n, F.col("width"), F.col("height"))).withColumns({"char_order": F.col("det_idx") + 1, "filename": char_file(F.col("det_idx") + 1)})


def reading_order(boxes: DataFrame, *by: str) -> DataFrame:
    """`position` from 1 by y, x, then detection."""
    return boxes.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy("y", "x", "char_order")))


def regions_of(response: DataFrame) -> DataFrame:
    """Region rows of a detector's response (image_id, width, height, ok, text_regions): boxes under any of three
    names, clamped; one whole-image region where it failed or found none."""
    fallback = response.where(~F.col("ok") | (F.coalesce(F.size("text_regions"), F.lit(0)) == 0))
    fallback = fallback.select("image_id", F.lit(1).alias("region_id"), F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.col("width").alias("x2"), F.col("height").alias("y2"), F.lit("").alias("text"), F.lit(0.0).alias("confidence"))
    listed = response.where("ok").select("image_id", "width", "height", F.posexplode("text_regions").alias("k", "r"))
    box = first_box(F.col("r"))
    boxed = listed.withColumn("box", box).where(F.size("box") >= 4).withColumns(clamp_box(*(F.col("box")[k].cast("int") for k in range(4)), F.col("width"), F.col("height")))
    named = boxed.select("image_id", (F.col("k") + 1).alias("region_id"), "x1", "y1", "x2", "y2", F.coalesce("r.text", F.lit("")).alias("text"), F.coalesce("r.confidence", F.lit(0.0)).alias("confidence"))
    return named.unionByName(fallback).withColumn("file", region_file(F.col("region_id")))


def expected_text(regions: DataFrame, texts: DataFrame) -> DataFrame:
    """`expected` of (dataset, region) by the region's name, else by dataset:region."""
    plain = texts.select(F.col("key").alias("region"), F.col("text").alias("by_region"))
    full = texts.select(F.col("key").alias("full_key"), F.col("text").alias("by_full"))
    keyed = regions.withColumn("full_key", F.concat_ws(":", "dataset", "region"))
    return keyed.join(plain, "region", "left").join(full, "full_key", "left").withColumn("expected", F.coalesce("by_region", "by_full")).drop("full_key", "by_region", "by_full")


def palette_index(k: Column, n: int = 10) -> Column:
    """The colour of the k-th region, k from 1."""
    return F.pmod(k - 1, F.lit(n))
