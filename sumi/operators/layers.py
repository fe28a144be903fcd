"""Composing drawings from five layers: all combinations, one at random, its layout and tints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the composition: assets of each layer, drawing order with mirrors, scale, tint.
COUNTS = {"A": 3, "B": 6, "C": 6, "D": 3, "E": 3}
ORDER = (("B", 1), ("C", 1), ("B", -1), ("C", -1), ("A", 1), ("D", 1), ("E", 1))
SCALE = 0.2
D_TOPS = (650, 800, 700)
TINT_LOW, TINT_HIGH, TINT_ALPHA = 50, 255, 255 * 0.66


def assets(spark: SparkSession) -> DataFrame:
    """layer and number (from 1) of every asset."""
    rows = [(layer, k) for layer, n in COUNTS.items() for k in range(1, n + 1)]
    return spark.createDataFrame(rows, "layer string, number int")


def combinations(spark: SparkSession) -> DataFrame:
    """Every choice of one asset of each layer; a product of five tables of fixed, tiny size."""
    one = lambda layer: spark.range(1, COUNTS[layer] + 1).select(F.col("id").cast("int").alias(layer.lower()))
    out = one("A")
    for layer in "BCDE":
        out = out.crossJoin(one(layer))
    return out


def pick(spark: SparkSession, seed: int) -> DataFrame:
    """One combination, uniformly at random."""
    return combinations(spark).orderBy(F.rand(seed)).limit(1)


def place(layer: Column, number: Column, width: Column, height: Column) -> dict[str, Column]:
    """Scaled size, and the centre of an asset of raw width and height."""
    w, h = width * SCALE, height * SCALE
    tops = F.element_at(F.array(*map(F.lit, D_TOPS)), number)
    x = F.when(layer == "B", 80 - w).when(layer == "C", 50 - w).otherwise(F.lit(0.0))
    y = F.when(layer == "A", h - 100).when(layer == "B", 260.0).when(layer == "C", 480.0).when(layer == "D", tops.cast("double")).otherwise(F.lit(380.0))
    return {"w": w, "h": h, "x": x, "y": y}


def draws(chosen: DataFrame, *by: str) -> DataFrame:
    """The seven drawings of each combination in order, with its columns `by`; mirrored ones have x_scale -1."""
    parts = F.array(*(F.struct(F.lit(z).alias("z"), F.lit(layer).alias("layer"), F.col(layer.lower()).alias("number"), F.lit(scale).alias("x_scale")) for z, (layer, scale) in enumerate(ORDER)))
    return chosen.select(*by, F.explode(parts).alias("p")).select(*by, "p.*")


def tints(drawn: DataFrame, seed: int) -> DataFrame:
    """A colour for each drawing: two random shades and a full channel, shuffled, on a fixed opacity."""
    shade = lambda k: F.floor(F.rand(seed + k) * (TINT_HIGH - TINT_LOW) + TINT_LOW).cast("int")
    return drawn.withColumns({"rgb": F.shuffle(F.array(shade(0), shade(1), F.lit(255)), F.lit(seed)), "alpha": F.lit(TINT_ALPHA)})
