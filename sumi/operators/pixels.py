"""Operators on the pixel table (image_id, y, x, v): the SQL form, which says what the raster kernels compute.

Windows and groups here are bounded by one raster; production rasters take the kernels of `arrow`, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import gamma_table

# ---- pointwise --------------------------------------------------------------------------------------------------


def contrast(v: Column, alpha: float = 1.5, beta: float = 10) -> Column:
    return F.least(F.lit(255), F.bround(F.abs(v * alpha + beta)).cast("int"))


def invert(v: Column) -> Column:
    return 255 - v


def gamma(v: Column, g: float) -> Column:
    return F.element_at(F.array(*(F.lit(int(k)) for k in gamma_table(g))), v + 1)


def gray(b: Column, g: Column, r: Column) -> Column:
    return F.floor((299 * r + 587 * g + 114 * b + 500) / 1000).cast("int")


def subtract(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), a - b)


def weighted(a: Column, wa: float, b: Column, wb: float) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.bround(a * wa + b * wb).cast("int")))


def tint(v: Column, on: Column, color: int, share: float = 0.7) -> Column:
    return F.when(on, (v * (1 - share) + color * share).cast("int")).otherwise(v)


def minmax(px: DataFrame) -> DataFrame:
    """Each raster stretched to 0..255, truncated; a flat one is 0."""
    w = Window.partitionBy("image_id")
    low, high = F.min("v").over(w), F.max("v").over(w)
    return px.withColumn("v", F.when(high > low, F.floor((F.col("v") - low) * 255 / F.greatest(high - low, F.lit(1)))).otherwise(0).cast("int"))


def bands(px: DataFrame, dark: int = 60, light: int = 230) -> DataFrame:
    v = F.col("v")
    return px.select("image_id", "y", "x", (v <= dark).cast("int").alias("dark"), ((v > dark) & (v < light)).cast("int").alias("light"))


# ---- thresholds -------------------------------------------------------------------------------------------------


def otsu(px: DataFrame) -> DataFrame:
    """(image_id, t): the first value with the largest between-class variance; 0 for flat rasters."""
    hist = px.groupBy("image_id", "v").agg(F.count("*").alias("n"))
    all_, upto = Window.partitionBy("image_id"), Window.partitionBy("image_id").orderBy("v")
    n, s = F.col("n"), F.col("n") * F.col("v")
    sums = hist.select("image_id", "v", F.sum(n).over(all_).alias("total"), F.sum(s).over(all_).alias("mass"), F.sum(n).over(upto).alias("below"), F.sum(s).over(upto).alias("below_mass"))
    gap = (F.col("mass") * F.col("below") - F.col("total") * F.col("below_mass")).cast("double")
    score = F.try_divide(gap * gap, (F.col("below") * (F.col("total") - F.col("below"))).cast("double"))
    best = sums.withColumn("score", score).groupBy("image_id").agg(F.max_by("v", F.struct(F.coalesce("score", F.lit(-1.0)), -F.col("v"))).alias("v"), F.max("score").alias("score"))
    return best.select("image_id", F.when(F.col("score").isNull(), 0).otherwise(F.col("v")).alias("t"))


def otsu_ink(px: DataFrame) -> DataFrame:
    """(image_id, y, x, v, ink): ink is 1 where v <= threshold."""
    return px.join(otsu(px), "image_id").select("image_id", "y", "x", "v", (F.col("v") <= F.col("t")).cast("int").alias("ink"))


def adaptive_ink(px: DataFrame, size: int, block: int = 5, c: int = 3) -> DataFrame:
    """Ink where v + c is at most the mean of a block in which edge pixels repeat; rasters are `size` wide and high.

    Each value is added to the pixels around it, along columns and then along rows; there is no join, whose sides would
    have many times the rows that their size on disk promises. Repeats of a pixel with one value give one row."""
    r = (block + 1 - block % 2) // 2
    last = size - 1

    def added(rows: DataFrame, axis: str) -> DataFrame:
        moved = rows.withColumn("d", F.explode(F.array(*(F.lit(d) for d in range(-r, r + 1))))).withColumn("at", F.col(axis) + F.col("d")).where(F.col("at").between(0, last))
        repeats = 1 + F.when(F.col(axis) == 0, F.greatest(F.lit(0), r - F.col("at"))).otherwise(0) + F.when(F.col(axis) == last, F.greatest(F.lit(0), F.col("at") + (r - last))).otherwise(0)
        return moved.withColumn("k", repeats).withColumn("own", F.when(F.col("d") == 0, F.col("own")))

    sums = F.sum(F.col("k") * F.col("s")).alias("s"), F.sum(F.col("k") * F.col("n")).alias("n")
    known = px.where("image_id is not null").select("image_id", "y", "x", F.col("v").alias("s"), F.lit(1).alias("n"), F.struct("v").alias("own"))
    down = added(known, "y").groupBy("image_id", F.col("at").alias("y"), "x").agg(*sums, F.collect_set("own").alias("own"))
    both = added(down, "x").groupBy("image_id", "y", F.col("at").alias("x")).agg(*sums, F.first("own", ignorenulls=True).alias("own"))
    return both.withColumn("own", F.explode("own")).select("image_id", "y", "x", ((F.col("own.v") + c) * F.col("n") <= F.col("s")).cast("int").alias("ink"))


def auto_invert(masked: DataFrame, on: str = "bright") -> DataFrame:
    """(image_id, inverted): the mask is inverted where its foreground is darker than its background."""
    fg = F.coalesce(F.avg(F.when(F.col(on) == 1, F.col("v"))), F.lit(255.0))
    bg = F.coalesce(F.avg(F.when(F.col(on) == 0, F.col("v"))), F.lit(0.0))
    return masked.groupBy("image_id").agg((fg < bg).alias("inverted"))


# ---- profiles and runs ------------------------------------------------------------------------------------------


def profile(ink: DataFrame, axis: str = "x") -> DataFrame:
    """(image_id, pos, ink_count, length) of each column (x) or row (y)."""
    return ink.groupBy("image_id", F.col(axis).alias("pos")).agg(F.sum("ink").alias("ink_count"), F.count("*").alias("length"))


def runs(profiles: DataFrame, least: float = 0.005, ratio: float = 0.01) -> DataFrame:
    """(image_id, start, end, mass): maximal stretches of coverage above both limits; mass in ink pixels."""
    cover = F.col("ink_count") / F.col("length")
    top = F.max(cover).over(Window.partitionBy("image_id"))
    above = profiles.withColumn("limit", F.greatest(F.lit(least), top * ratio)).where(cover > F.col("limit"))
    island = F.col("pos") - F.row_number().over(Window.partitionBy("image_id").orderBy("pos"))
    grouped = above.withColumn("island", island).groupBy("image_id", "island")
    return grouped.agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.sum("ink_count").alias("mass")).drop("island")


# ---- neighbourhoods ---------------------------------------------------------------------------------------------


def _beside(px: DataFrame, value: str, r: int = 1) -> DataFrame:
    """Every pixel's value at all offsets of a square: (image_id, y, x, dy, dx, n), inside the raster."""
    near = F.sequence(F.lit(-r), F.lit(r))
    moved = px.withColumn("dy", F.explode(near)).withColumn("dx", F.explode(near))
    return moved.select("image_id", (F.col("y") - F.col("dy")).alias("y"), (F.col("x") - F.col("dx")).alias("x"), "dy", "dx", F.col(value).alias("n"))


def extreme3(px: DataFrame, value: str, largest: bool) -> DataFrame:
    """Dilation or erosion by a 3 x 3 square: the largest or smallest value around."""
    pick = F.max("n") if largest else F.min("n")
    return px.select("image_id", "y", "x").join(_beside(px, value).groupBy("image_id", "y", "x").agg(pick.alias(value)), ["image_id", "y", "x"])


def stencil(px: DataFrame, size: int, weights: dict[tuple[int, int], int], name: str) -> DataFrame:
    """Sum of weighted neighbours; outside, the raster is reflected about its edge pixels."""
    return stencils(px, size, {name: weights})


def stencils(px: DataFrame, size: int, named: dict[str, dict[tuple[int, int], int]]) -> DataFrame:
    """(image_id, y, x) and the sum of each stencil in one pass, where each has a neighbour.

    Values are laid around the raster where it is reflected, then each is added to the pixels that see it: no join, as
    in `adaptive_ink`."""
    last = size - 1
    offsets = sorted({(0, 0)}.union(*named.values()))
    r = max(max(abs(dy), abs(dx)) for dy, dx in offsets)
    laid = px.where("image_id is not null").select("image_id", "y", "x", "v")
    for axis in "yx":
        c = F.col(axis)
        places = F.array(c, F.when((c > 0) & (c <= r), -c), F.when((c < last) & (c >= last - r), 2 * last - c))
        laid = laid.withColumn("at", F.explode(places)).where("at is not null").drop(axis).withColumnRenamed("at", axis)
    weight = lambda w, at: F.lit(w.get(at)).cast("int")
    terms = F.array(*(F.struct(F.lit(at[0]).alias("dy"), F.lit(at[1]).alias("dx"), *(weight(w, at).alias(f"k{i}") for i, w in enumerate(named.values()))) for at in offsets))
    seen = laid.withColumn("w", F.explode(terms)).select("image_id", (F.col("y") - F.col("w.dy")).alias("y"), (F.col("x") - F.col("w.dx")).alias("x"), "v", "w")
    seen = seen.where(F.col("y").between(0, last) & F.col("x").between(0, last))
    here = F.count(F.when((F.col("w.dy") == 0) & (F.col("w.dx") == 0), 1))  # the pixel itself, as often as it is there
    each = [(F.sum(F.col(f"w.k{i}") * F.col("v")) * here).alias(name) for i, name in enumerate(named)]
    sums = seen.groupBy("image_id", "y", "x").agg(*each, here.alias("here"), *(F.count(f"w.k{i}").alias(f"n{i}") for i in range(len(named))))
    return sums.where(" and ".join(["here > 0", *(f"n{i} > 0" for i in range(len(named)))])).select("image_id", "y", "x", *named)


# ---- component decisions ----------------------------------------------------------------------------------------


def component_stats(labelled: DataFrame) -> DataFrame:
    """x, y, w, h, area of each label of (image_id, label, y, x)."""
    return labelled.groupBy("image_id", "label").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), F.count("*").alias("area"))


def tier(stats: DataFrame, width: int, height: int, how) -> DataFrame:
    """`tier` (border_touch, edge_zone, interior) and `removed` of each component."""
    x, y, w, h, area = (F.col(c) for c in ("x", "y", "w", "h", "area"))
    within = lambda m: (x <= m) | (y <= m) | (x + w >= width - m) | (y + h >= height - m)
    least = lambda ratio: max(1, int(ratio * width * height))
    odd = (F.greatest(w / F.greatest(h, F.lit(1)), h / F.greatest(w, F.lit(1))) >= how.max_aspect) | (F.least(w, h) <= how.min_dim)
    kind = F.when(within(how.touch_margin), "border_touch").when(within(how.zone_margin), "edge_zone").otherwise("interior")
    limit = F.when(kind == "border_touch", least(how.touch_ratio)).when(kind == "edge_zone", least(how.zone_ratio)).otherwise(least(how.interior_ratio))
    return stats.withColumns({"tier": kind, "removed": (area < limit) | ((kind != "interior") & odd)})


def noise(stats: DataFrame, how) -> DataFrame:
    """`noise` of each component of the light band."""
    w, h, area = F.col("w"), F.col("h"), F.col("area")
    slender = (F.greatest(w, h) / F.least(w, h) > how.max_aspect) & (area < how.slender_area)
    return stats.withColumn("noise", area.between(how.least_area, how.most_area) & ((area > how.large_area) | slender))


def largest(stats: DataFrame) -> DataFrame:
    """The component of most pixels of each raster, the first of equals."""
    return stats.groupBy("image_id").agg(F.max_by(F.struct("label", "area"), F.struct("area", -F.col("label"))).alias("s")).select("image_id", "s.label", "s.area")
