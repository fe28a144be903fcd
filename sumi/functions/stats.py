"""Exact statistics of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096


def median(df: DataFrame, group: str, value: str, bins: int = BINS) -> DataFrame:
    """`group` and `median`, the mean of the two middle values. Counts of equal-width bins locate the middle ranks, and
    only the values of the bins that hold them are sorted; null values do not count."""
    rows = df.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("v"))
    ends = rows.groupBy(group).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    at = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0)) * bins))
    binned = rows.join(F.broadcast(ends) if ends.limit(100_001).count() <= 100_000 else ends, group).withColumn("bin", at)
    till = F.sum("m").over(Window.partitionBy(group).orderBy("bin"))
    first, second = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1  # the middle ranks, from 1
    counts = binned.groupBy(group, "bin").agg(F.count("*").alias("m"), F.first("n").alias("n")).withColumn("till", till).withColumn("before", F.col("till") - F.col("m"))
    holds = lambda rank: (F.col("before") < rank) & (F.col("till") >= rank)
    hit = counts.where(holds(first) | holds(second)).select(group, "bin", "before")
    ranked = binned.join(hit, [group, "bin"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy(group, "bin").orderBy("v")))
    return ranked.where((F.col("rank") == first) | (F.col("rank") == second)).groupBy(group).agg(F.avg("v").alias("median"))
