"""Schemas of rasters, regions, characters and verdicts."""

from pyspark.sql import types as T

BOX = T.StructType([T.StructField(c, T.IntegerType()) for c in ("x1", "y1", "x2", "y2")])  # half-open
RASTER = "image_id string, height int, width int, n_channels int, data binary"
PIXEL = "image_id long, y int, x int, v int"
REGIONS = "image_id string, region_id int, file string, bbox array<int>, text string, confidence double"
DETECTED = "image_id string, region_id int, det_idx int, text string, confidence double, nbox array<double>"
CHARS = "image_id string, region_id int, char_order int, filename string, x int, y int, w int, h int, text string, confidence double, height int, width int, n_channels int, data binary"
REPLY = "raw string, response_time double, error string"
STAGE_ERROR = "struct<ok:boolean,error:string>"
