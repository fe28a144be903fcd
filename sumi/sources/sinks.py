"""Writers: rasters as Parquet and PNG, records as JSON, contours as SVG, named copies."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .images import encode_png, to_array


def with_png(rasters: DataFrame) -> DataFrame:
    """`png` beside each raster, encoded where the raster is."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rasters.schema.fields)

    def run(batches):
        for batch in batches:
            get = {n: batch.column(n).to_pylist() for n in ("data", "height", "width", "n_channels")}
            png = [encode_png(to_array(*row)) for row in zip(get["data"], get["height"], get["width"], get["n_channels"], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(png, pa.binary())], names=[*batch.schema.names, "png"])

    return rasters.mapInArrow(run, f"{schema}, png binary")


def write_rasters(rasters: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = rasters.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_files(named: DataFrame, folder: str, name: str = "output_file", body: str = "png") -> DataFrame:
    """Write bytes under their names from the executors, as the result is read: one row (file, bytes) for each.

    `folder` is a URI of storage that all executors reach. A file gets its name when it is whole; a task that runs
    again writes the same bytes again."""

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            names, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for n, b in zip(names, bodies, strict=True):
                part = f"{root}/.{n}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(b)
                store.move(part, f"{root}/{n}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) for b in bodies], pa.int64())], names=["file", "bytes"])

    return named.select(name, body).mapInArrow(run, "file string, bytes long")


def write_json(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def svg_path(points: Column) -> Column:
    """M x y L x y ... Z of an array of (x, y); empty for no points."""
    spelt = F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return F.when(F.size(points) > 0, F.concat(F.lit("M "), F.array_join(spelt, " L "), F.lit(" Z"))).otherwise("")


def svg(paths: Column, width: Column, height: Column) -> Column:
    """A drawing of the paths (array of strings) that are not empty."""
    size = lambda c: c.cast("string")
    head = F.concat(F.lit("<svg xmlns='http://www.w3.org/2000/svg' width='"), size(width), F.lit("' height='"), size(height), F.lit("' viewBox='0 0 "), size(width), F.lit(" "), size(height), F.lit("'>"))
    lines = F.transform(F.filter(paths, lambda p: p != ""), lambda p: F.concat(F.lit("  <path d='"), p, F.lit("' />")))
    return F.array_join(F.flatten(F.array(F.array(head, F.lit("<g fill='none' stroke='red' stroke-width='2'>")), lines, F.array(F.lit("</g>"), F.lit("</svg>")))), "\n")


def write_svg(drawings: DataFrame, path: str, column: str = "svg") -> None:
    drawings.select(column).write.mode("overwrite").text(path, lineSep="\n\n")
