"""Image files and cached results."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The file types that are read, and the MIME types a detector is told (.tif falls to the default).
EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".tif")
MIME = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".bmp": "image/bmp", ".tiff": "image/tiff", ".webp": "image/webp"}
DEFAULT_MIME = "image/jpeg"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def is_image(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def mime_type(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv))
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit(DEFAULT_MIME))


def list_images(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path and length of the image files below a folder, or of one file, by path; a missing path fails when it is
    read. Only names and lengths are read, so the order costs a sort of these."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.where(is_image(F.col("path"))).select("path", "length").orderBy("path")


def _decoded(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    found = spark.read.format("image").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{jpg,jpeg,png,bmp,tiff,tif,JPG,JPEG,PNG,BMP,TIFF,TIF}").load(path)
    return found.select(F.col("image.origin").alias("image_id"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("n_channels"), F.col("image.data").alias("data"))


def read_images(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Raster rows of all images that decode (B, G, R); `unreadable_images` has the others."""
    return _decoded(spark, path, recursive).where("height > 0")


def unreadable_images(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(image_id, error) of the image files that do not decode."""
    return _decoded(spark, path, recursive).where("height <= 0").select("image_id", F.lit("does not decode").alias("error"))


def region_images(files: DataFrame) -> DataFrame:
    """Region files by dataset: those named region_*, and the dataset their path says."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.where(is_image(F.col("path")) & name.startswith("region_")).select("path", dataset_key(F.col("path")).alias("dataset"), name.alias("region"))


def char_folders(files: DataFrame) -> DataFrame:
    """Folders that hold char_* images, none of them debug folders."""
    name, folder = F.regexp_extract("path", r"([^/]+)$", 1), F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    return files.where(is_image(F.col("path")) & name.startswith("char_") & ~F.col("path").contains("/debug/")).select(folder.alias("folder")).distinct()


def dataset_key(path: Column) -> Column:
    """The path element after the first `preocr`, else misc."""
    found = F.regexp_extract(path, r"(?:^|/)preocr/([^/]+)", 1)
    return F.when(found != "", found).otherwise("misc")


def pending(work: DataFrame, done: DataFrame, on: list[str], force: bool = False) -> DataFrame:
    """Rows without a cached result; all of them if forced."""
    return work if force else work.join(done.select(*on).distinct(), on, "left_anti")


def to_array(data: bytes, height: int, width: int, n_channels: int) -> np.ndarray:
    """A raster of a row; alpha goes, pages of code points become gray."""
    if n_channels == 1 and len(data) != height * width:
        codes = np.frombuffer(data, ">u4")
        out = np.full(height * width, 255, np.uint8)
        out[: len(codes)] = np.where((codes == 32) | (codes == 9), 255, 255 - codes % 256)
        return out.reshape(height, width)
    x = np.frombuffer(data, np.uint8).reshape(height, width, n_channels)
    return x[..., 0] if n_channels == 1 else x[..., :3]


def encode_png(x: np.ndarray) -> bytes:
    """A PNG of a gray or B, G, R raster."""
    colour = x.ndim == 3
    rows = x[..., ::-1] if colour else x[..., None]
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows.reshape(len(rows), -1)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, 2 if colour else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
