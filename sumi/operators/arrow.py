"""Kernels over raster rows, one Arrow batch at a time: no shuffle, one raster in memory with its results."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..schema import RASTER
from ..sources.images import to_array

#: Rows gathered before a batch goes back to Spark; rasters are large rows.
ROWS_OUT = 2_000


def _schema(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def each_raster(rasters: DataFrame, rows: Callable[[str, np.ndarray], Iterable[tuple]], schema: str, lazy: bool = False) -> DataFrame:
    """The rows that `rows(image_id, raster)` gives, for all rasters; with `lazy` the raster is a function to call."""
    arrow = to_arrow_schema(_schema(schema))

    def run(batches):
        out = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [()] * len(arrow), arrow, strict=True)], names=arrow.names)
        for batch in batches:
            get = {n: batch.column(n).to_pylist() for n in ("image_id", "height", "width", "n_channels", "data")}
            for key, h, w, n, data in zip(*get.values(), strict=True):
                out += rows(key, (lambda a=(data, h, w, n): to_array(*a)) if lazy else to_array(data, h, w, n))
                if len(out) >= ROWS_OUT:
                    yield flush()
                    out.clear()
        yield flush()

    return rasters.select("image_id", "height", "width", "n_channels", "data").mapInArrow(run, schema)


def map_raster(rasters: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Raster rows of the kernel's results; neighbouring calls are best fused into one kernel."""

    def rows(key, x):
        y = np.ascontiguousarray(kernel(x))
        yield key, y.shape[0], y.shape[1], 1 if y.ndim == 2 else 3, y.tobytes()

    return each_raster(rasters, rows, RASTER)


def try_raster(rasters: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """As `map_raster`, with `error`: a raster that the kernel or the decoding rejects is a row without data."""

    def rows(key, x):
        try:
            y = np.ascontiguousarray(kernel(x()))
        except Exception as e:  # the reason is the row's result
            yield key, None, None, None, None, f"{type(e).__name__}: {e}"
        else:
            yield key, y.shape[0], y.shape[1], 1 if y.ndim == 2 else 3, y.tobytes(), None

    return each_raster(rasters, rows, f"{RASTER}, error string", lazy=True)


def pixel_rows(rasters: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], name: str = "v") -> DataFrame:
    """(image_id, y, x, value) of the kernel's results; for small rasters and tests."""

    def rows(key, x):
        y = kernel(x)
        for (i, j), v in np.ndenumerate(y):
            yield int(key), i, j, int(v)

    return each_raster(rasters, rows, f"image_id long, y int, x int, {name} int")
