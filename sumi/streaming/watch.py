"""Preprocessing of images as they arrive: a file source, one checkpoint, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.images import EXTENSIONS


def arriving(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """path, modificationTime, length and content of new image files below a folder."""
    kinds = ",".join(e[1:] for e in EXTENSIONS)
    source = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{kinds}}}").option("maxFilesPerTrigger", files_per_trigger)
    return source.schema("path string, modificationTime timestamp, length long, content binary").load(folder)


def run_on_arrivals(spark: SparkSession, folder: str, stage, out: str, checkpoint: str, once: bool = True):
    """Decode each arriving batch by Spark's image source and write what `stage` makes of it to a folder of its own,
    `batch=<number>`: a batch that runs again after a failure replaces what it had written."""
    from ..sources.images import read_images

    def step(batch: DataFrame, number: int) -> None:
        paths = [r.path for r in batch.select("path").toLocalIterator()]  # names of one trigger's files, bounded by it
        if paths:
            stage(read_images(spark, paths)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = arriving(spark, folder).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
