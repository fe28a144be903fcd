"""Single-image jobs: mask and contours, texture edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ContourJob, TextureJob
from ..operators import kernels as K
from ..operators.arrow import each_raster, map_raster
from ..sources.sinks import svg, svg_path

CONTOURS = "image_id string, height int, width int, fill double, contours array<struct<area:double,points:array<struct<x:int,y:int>>>>"


def mask(bgr: np.ndarray, job: ContourJob) -> np.ndarray:
    bgr = K.to_bgr(bgr)
    x = K.gray(K.enhance(bgr, job.enhance, job.clahe_clip, job.clahe_tile, job.sat_factor, job.gamma) if job.use_enhanced_for_mask else bgr)
    x = K.bilateral(x, 7, 50, 7) if job.bilateral else K.gaussian(x, 5)
    out = K.cascade(x, job.method, job.invert)
    if job.morph:
        out = K.cleanup(out, job.close_k, job.open_k, job.close_iter, job.open_iter)
    if job.keep_biggest:
        out = K.biggest(out)
    return np.where(out > 0, 255, 0).astype(np.uint8)


def contours_of(binary: np.ndarray, job: ContourJob) -> list[tuple[float, list]]:
    """Contours of at least the least area, largest first, simplified if asked."""
    chains = [K.chain(points, job.chain) for points, _ in K.borders(binary, job.external)]
    sized = [(K.area(c), c) for c in chains]
    kept = sorted((s for s in sized if s[0] >= job.min_area * binary.size), key=lambda s: -s[0])
    return [(K.area(c), c) for c in (K.simplify(c, job.simplify) if job.simplify > 0 else c for _, c in kept)]


def extract_contours(images: DataFrame, job: ContourJob = ContourJob()) -> DataFrame:
    """Contours, fill and SVG of each image's mask."""

    def rows(key, x):
        m = mask(x, job)
        found = [{"area": a, "points": [{"x": int(p), "y": int(q)} for p, q in c]} for a, c in contours_of(m, job)]
        yield key, m.shape[0], m.shape[1], float((m > 0).mean()), found

    out = each_raster(images, rows, CONTOURS)
    paths = F.transform("contours", lambda c: svg_path(c["points"]))
    return out.withColumn("svg", svg(paths, F.col("width"), F.col("height")))


def texture_kernel(job: TextureJob | ContourJob):
    enhanced = job.use_enhanced if isinstance(job, TextureJob) else job.use_enhanced_for_texture

    def run(x):
        x = K.to_bgr(x)
        if enhanced:
            x = K.enhance(x, job.enhance, job.clahe_clip, job.clahe_tile, job.sat_factor, job.gamma)
        return K.texture_edges(x, job.texture_method, job.texture_sigma, job.texture_thresh, job.texture_close_k, job.texture_blur_ksize)

    return run


def extract_texture(images: DataFrame, job: TextureJob = TextureJob()) -> DataFrame:
    """Edge rasters."""
    return map_raster(images, texture_kernel(job))


def overlays(images: DataFrame, job: ContourJob = ContourJob()) -> DataFrame:
    """The image with its contours drawn, and edges tinted where the job has texture."""
    edges = texture_kernel(job)

    def run(x):
        out = K.to_bgr(x)
        for _, c in contours_of(mask(x, job), job):
            out = K.draw(out, c, thickness=job.thickness)
        return K.tint(out, edges(x)) if job.texture else out

    return map_raster(images, run)
