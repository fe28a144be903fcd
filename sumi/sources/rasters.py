"""Rasters derived from tables: a vector as 8 x 8 gray, three vectors as colour, a text as a page of 64 columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8
PAGE = 64


def gray_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id and px, the 64 gray values floor((v + 1) * 127.5) of a vector in row-major order."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    value = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 1) * 127.5).cast("int")))
    return vectors.select(F.col("vec_id").alias("image_id"), F.transform("embedding", value).alias("px"))


def stretched_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, each raster stretched to 0..255 so that dark and light bands occur."""
    low, high = F.array_min("px"), F.array_max("px")
    stretched = F.transform("px", lambda v: F.floor((v - low) * 255 / F.greatest(high - low, F.lit(1))).cast("int"))
    return gray_arrays(spark, sf_dir).withColumn("px", stretched)


def pixels(arrays: DataFrame, together: bool = False) -> DataFrame:
    """The pixel table image_id, y, x, v of rasters SIDE wide. `together` moves whole rasters by id before they become
    rows, which is the only shuffle that windows, groups and joins of a raster then need."""
    flat = (arrays.repartition("image_id") if together else arrays).select("image_id", F.posexplode("px").alias("p", "v"))
    return flat.select("image_id", F.floor(F.col("p") / SIDE).cast("int").alias("y"), (F.col("p") % SIDE).alias("x"), "v")


def colour_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id and b, g, r: vectors 3k, 3k + 1 and 3k + 2; incomplete triples go."""
    grays = gray_arrays(spark, sf_dir)
    channel = lambda k: F.max(F.when(F.col("image_id") % 3 == k, F.col("px")))
    triples = grays.groupBy(F.floor(F.col("image_id") / 3).alias("image_id")).agg(channel(0).alias("b"), channel(1).alias("g"), channel(2).alias("r"))
    return triples.where("b is not null and g is not null and r is not null")


def colour_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    zipped = colour_arrays(spark, sf_dir).select("image_id", F.posexplode(F.arrays_zip("b", "g", "r")).alias("p", "c"))
    return zipped.select("image_id", F.floor(F.col("p") / SIDE).cast("int").alias("y"), (F.col("p") % SIDE).alias("x"), "c.b", "c.g", "c.r")


def rasters(arrays: DataFrame, side: int = SIDE) -> DataFrame:
    """Gray arrays as raster rows."""
    data = F.unhex(F.array_join(F.transform("px", lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    return arrays.select(F.col("image_id").cast("string").alias("image_id"), F.lit(side).alias("height"), F.lit(side).alias("width"), F.lit(1).alias("n_channels"), data.alias("data"))


def colour_rasters(spark: SparkSession, sf_dir: str, side: int = SIDE) -> DataFrame:
    arrays = colour_arrays(spark, sf_dir).withColumn("px", F.flatten(F.transform(F.arrays_zip("b", "g", "r"), lambda c: F.array(c["b"], c["g"], c["r"]))))
    return rasters(arrays, side).withColumn("n_channels", F.lit(3))


def glyph_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as pages: position p at (p div 64, p mod 64), 255 - (first UTF-8 byte's code point mod 256)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.translate(F.coalesce("text", F.lit("")), "\r\n", "  ").alias("t"))
    rows = F.ceil(F.length("t") / PAGE).cast("int")
    return docs.select(F.col("doc_id").cast("string").alias("image_id"), rows.alias("height"), F.lit(PAGE).alias("width"), F.lit(1).alias("n_channels"), F.encode("t", "utf-32").alias("data"))
