"""The registered queries of the raster operators, and the same in SQL for DuckDB."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import Border, ComponentFilter, ContourJob, Noise, Settings, TextureJob, Trim
from .functions import register
from .functions import stats as T
from .functions import text as X
from .operators import boxes as B
from .operators import glyphs as G
from .operators import kernels as K
from .operators import layers as L
from .operators import pixels as P
from .operators.arrow import each_raster, map_raster, pixel_rows
from .plans import jobs, stages
from .sources import images as I
from .sources import rasters as R
from .sources import sinks as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name, with SQL where that says the same."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- SQL building blocks ----------------------------------------------------------------------------------------

V = "greatest(0, least(255, floor((embedding[i + 1]::DOUBLE + 1) * 127.5)::INT))"
PX = f"px AS (SELECT vec_id AS image_id, (i // 8)::INT AS y, (i % 8)::INT AS x, {V} AS v FROM embeddings, (SELECT unnest(range(64)) AS i))"
ST = f"px0 AS (SELECT vec_id AS image_id, (i // 8)::INT AS y, (i % 8)::INT AS x, {V} AS v FROM embeddings, (SELECT unnest(range(64)) AS i)), px AS (SELECT image_id, y, x, floor((v - min(v) OVER w) * 255 / greatest(max(v) OVER w - min(v) OVER w, 1))::INT AS v FROM px0 WINDOW w AS (PARTITION BY image_id))"
OTSU = """h AS (SELECT image_id, v, count(*) AS n FROM px GROUP BY ALL),
c AS (SELECT image_id, v, sum(n) OVER a AS total, sum(n * v) OVER a AS mass, sum(n) OVER u AS below, sum(n * v) OVER u AS below_mass FROM h
      WINDOW a AS (PARTITION BY image_id), u AS (PARTITION BY image_id ORDER BY v)),
o AS (SELECT image_id, CASE WHEN max(s) IS NULL THEN 0 ELSE arg_max(v, s) END AS t FROM (SELECT image_id, v, CASE WHEN below < total THEN
      (mass * below - total * below_mass)::DOUBLE * (mass * below - total * below_mass)::DOUBLE / (below * (total - below))::DOUBLE END AS s FROM c ORDER BY image_id, v) GROUP BY image_id),
ink AS (SELECT image_id, y, x, v, (v <= t)::INT AS ink FROM px JOIN o USING (image_id))"""
#: The first of equal scores: spelt by rank, as arg_max does not promise it.
OTSU = OTSU.replace("arg_max(v, s)", "min(v) FILTER (WHERE s = m)").replace("FROM (SELECT image_id, v, CASE", "FROM (SELECT *, max(s) OVER (PARTITION BY image_id) AS m FROM (SELECT image_id, v, CASE").replace("FROM c ORDER BY image_id, v) GROUP", "FROM c)) GROUP")
COL = "pr AS (SELECT image_id, x AS pos, sum(ink)::BIGINT AS n, count(*) AS length FROM ink GROUP BY ALL)"
RUNS = """ab AS (SELECT *, pos - row_number() OVER (PARTITION BY image_id ORDER BY pos) AS island FROM (
  SELECT *, n / length AS cover, max(n / length) OVER (PARTITION BY image_id) AS top FROM pr) WHERE cover > greatest(0.005, 0.01 * top)),
runs AS (SELECT image_id, min(pos) AS "start", max(pos) + 1 AS "end", sum(n)::BIGINT AS mass FROM ab GROUP BY image_id, island)"""
COLOUR = f"g AS (SELECT vec_id, i, {V} AS v FROM embeddings, (SELECT unnest(range(64)) AS i)), cpx AS (SELECT b.vec_id // 3 AS image_id, (b.i // 8)::INT AS y, (b.i % 8)::INT AS x, b.v AS b, g.v AS g, r.v AS r FROM g AS b JOIN g ON g.vec_id = b.vec_id + 1 AND g.i = b.i JOIN g AS r ON r.vec_id = b.vec_id + 2 AND r.i = b.i WHERE b.vec_id % 3 = 0)"
NEAR = "near AS (SELECT dy, dx FROM (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx))"
LABEL = """walk AS (SELECT image_id, y * 8 + x AS root, y, x FROM ink WHERE ink = 1
  UNION SELECT w.image_id, w.root, i.y, i.x FROM walk AS w JOIN ink AS i ON i.image_id = w.image_id AND i.ink = 1 AND abs(i.y - w.y) <= 1 AND abs(i.x - w.x) <= 1 WHERE w.root <= i.y * 8 + i.x),
lab0 AS (SELECT image_id, y, x, min(root) AS root FROM walk GROUP BY ALL),
lab AS (SELECT image_id, y, x, dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS label FROM lab0),
st AS (SELECT image_id, label, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area FROM lab GROUP BY ALL)"""


DOUBLE = lambda v: f"{v:.17e}::DOUBLE"


def _level_sql(source: str, out: str) -> str:
    """Otsu's threshold of any pixel table, as `out` (image_id, t)."""
    return f"""{out}_h AS (SELECT image_id, v, count(*) AS n FROM {source} GROUP BY ALL),
{out}_c AS (SELECT image_id, v, sum(n) OVER a AS total, sum(n * v) OVER a AS mass, sum(n) OVER u AS below, sum(n * v) OVER u AS below_mass FROM {out}_h WINDOW a AS (PARTITION BY image_id), u AS (PARTITION BY image_id ORDER BY v)),
{out}_s AS (SELECT *, CASE WHEN below < total THEN (mass * below - total * below_mass)::DOUBLE * (mass * below - total * below_mass)::DOUBLE / (below * (total - below))::DOUBLE END AS s FROM {out}_c),
{out} AS (SELECT image_id, coalesce(min(v) FILTER (WHERE s = m), 0) AS t FROM (SELECT *, max(s) OVER (PARTITION BY image_id) AS m FROM {out}_s) GROUP BY image_id)"""


#: Structuring elements as conditions on the offsets dy and dx.
CROSS, FLAT, TALL = "abs(dy) + abs(dx) <= 1", "dy = 0 AND abs(dx) <= 1", "dx = 0 AND abs(dy) <= 1"
ROUND5 = "(abs(dy) <= 1 AND abs(dx) <= 2) OR (abs(dy) = 2 AND dx = 0)"


def _extreme_sql(source: str, pick: str, shape: str, out: str) -> str:
    """The least or greatest of each pixel's neighbours within a symmetric element."""
    near = f"(SELECT dy, dx FROM (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx) WHERE {shape})"
    return f"{out} AS (SELECT a.image_id, a.y, a.x, {pick}(b.v) AS v FROM {source} AS a, {near} AS t, {source} AS b WHERE b.image_id = a.image_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY a.image_id, a.y, a.x)"


def _steps_sql(source: str, out: str, *steps: tuple[str, str]) -> str:
    """Several of them in a row, the last as `out`."""
    names = [source, *(f"{out}_{k}" for k in range(1, len(steps))), out]
    return ", ".join(_extreme_sql(a, pick, shape, b) for a, b, (pick, shape) in zip(names, names[1:], steps, strict=False))


def with_(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} "


def _px(spark, sf_dir):
    return R.pixels(R.gray_arrays(spark, sf_dir))


def _together(spark, sf_dir):
    return R.pixels(R.gray_arrays(spark, sf_dir), together=True)


def _stretched(spark, sf_dir):
    return R.pixels(R.stretched_arrays(spark, sf_dir))


def _rasters(spark, sf_dir):
    return R.rasters(R.gray_arrays(spark, sf_dir))


def _stretched_rasters(spark, sf_dir):
    return R.rasters(R.stretched_arrays(spark, sf_dir))


def _long(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c, t in df.dtypes if t in ("int", "smallint")})


# ---- pointwise --------------------------------------------------------------------------------------------------


@query(with_(PX) + "SELECT image_id, y, x, v FROM px")
def pixel_table(spark, sf_dir):
    return _px(spark, sf_dir)


@query(with_(PX) + "SELECT image_id, y, x, least(255, CASE WHEN (v * 3 + 20) % 2 = 0 OR ((v * 3 + 19) // 2) % 2 = 0 THEN (v * 3 + 20) // 2 ELSE (v * 3 + 20) // 2 + 1 END)::INT AS v FROM px")
def contrast(spark, sf_dir):
    return _px(spark, sf_dir).withColumn("v", P.contrast(F.col("v")))


@query(with_(PX) + "SELECT image_id, y, x, 255 - v AS v FROM px")
def invert(spark, sf_dir):
    return _px(spark, sf_dir).withColumn("v", P.invert(F.col("v")))


@query(with_(PX) + "SELECT image_id, y, x, trunc(pow(v / 255.0::DOUBLE, 1.0::DOUBLE / 1.5::DOUBLE) * 255)::INT AS v FROM px")
def gamma_lut(spark, sf_dir):
    return _px(spark, sf_dir).withColumn("v", P.gamma(F.col("v"), 1.5))


@query(with_(COLOUR) + "SELECT image_id, y, x, ((299 * r + 587 * g + 114 * b + 500) // 1000)::INT AS v FROM cpx")
def gray_from_bgr(spark, sf_dir):
    c = R.colour_pixels(spark, sf_dir)
    return c.select("image_id", "y", "x", P.gray(F.col("b"), F.col("g"), F.col("r")).alias("v"))


@query(with_(PX) + "SELECT image_id, y, x, CASE WHEN max(v) OVER w > min(v) OVER w THEN floor((v - min(v) OVER w) * 255 / (max(v) OVER w - min(v) OVER w))::INT ELSE 0 END AS v FROM px WINDOW w AS (PARTITION BY image_id)")
def minmax_normalise(spark, sf_dir):
    return P.minmax(_together(spark, sf_dir))


@query(with_(ST) + "SELECT image_id, y, x, (v <= 60)::INT AS dark, (v > 60 AND v < 230)::INT AS light FROM px")
def band_masks(spark, sf_dir):
    return P.bands(_stretched(spark, sf_dir))


@query(with_(ST) + "SELECT image_id, y, x, CASE WHEN v > 127 THEN trunc(v * 0.3::DOUBLE + 178.5::DOUBLE)::INT ELSE v END AS v FROM px")
def overlay_tint(spark, sf_dir):
    v = F.col("v")
    return _stretched(spark, sf_dir).withColumn("v", F.when(v > 127, (v * 0.3 + 178.5).cast("int")).otherwise(v))


@query(with_(ST) + "SELECT a.image_id, a.y, a.x, greatest(0, a.v - b.v) AS minus, abs(a.v - b.v) AS difference, a.v | b.v AS either, a.v & (255 - b.v) AS only_first FROM px AS a JOIN px AS b ON a.image_id = b.image_id AND a.y = b.y AND b.x = 7 - a.x")
def mask_algebra(spark, sf_dir):
    """Saturating and bitwise operations of each raster with its mirror image."""
    a = _stretched(spark, sf_dir)
    b = a.select("image_id", "y", (7 - F.col("x")).alias("x"), F.col("v").alias("u"))
    v, u = F.col("v"), F.col("u")
    return a.join(b, ["image_id", "y", "x"]).select("image_id", "y", "x", P.subtract(v, u).alias("minus"), F.abs(v - u).alias("difference"), v.bitwiseOR(u).alias("either"), v.bitwiseAND(255 - u).alias("only_first"))


# ---- stencils and edges in SQL ---------------------------------------------------------------------------------


def _stencil_sql(weights: dict, name: str, source: str = "px") -> str:
    mirror = lambda c: f"CASE WHEN {c} < 0 THEN -({c}) WHEN {c} > 7 THEN 14 - ({c}) ELSE {c} END"
    rows = ", ".join(f"({dy}, {dx}, {k})" for (dy, dx), k in weights.items())
    return f"{name} AS (SELECT a.image_id, a.y, a.x, sum(k * b.v)::BIGINT AS n FROM {source} AS a, (VALUES {rows}) AS t(dy, dx, k), {source} AS b WHERE b.image_id = a.image_id AND b.y = {mirror('a.y + dy')} AND b.x = {mirror('a.x + dx')} GROUP BY a.image_id, a.y, a.x)"


GX = {(-1, -1): -1, (-1, 1): 1, (0, -1): -2, (0, 1): 2, (1, -1): -1, (1, 1): 1}
GY = {(x, y): k for (y, x), k in GX.items()}
LAP = {(-1, -1): 2, (-1, 1): 2, (1, -1): 2, (1, 1): 2, (0, 0): -8}


def _canny_sql(source: str, low: str, high: str, out: str) -> str:
    """Canny edges of a pixel table as `out` (image_id, y, x, v). The limits may use `median`; rasters of 8 by 8."""
    step = f"CASE WHEN abs(gy) <= abs(gx) * {DOUBLE(math.tan(math.pi / 8))} THEN 0 WHEN abs(gy) >= abs(gx) * {DOUBLE(math.tan(3 * math.pi / 8))} THEN 1 WHEN (gx >= 0) = (gy >= 0) THEN 2 ELSE 3 END"
    return f"""{_stencil_sql(GX, out + "_gx", source)}, {_stencil_sql(GY, out + "_gy", source)},
{out}_m AS (SELECT image_id, y, x, abs(gx) + abs(gy) AS m, CASE d WHEN 1 THEN 0 ELSE -1 END * CASE d WHEN 3 THEN -1 ELSE 1 END AS dx, CASE d WHEN 0 THEN 0 ELSE -1 END AS dy
  FROM (SELECT *, {step} AS d FROM (SELECT a.image_id, a.y, a.x, a.n AS gx, b.n AS gy FROM {out}_gx AS a JOIN {out}_gy AS b USING (image_id, y, x)))),
{out}_t AS (SELECT image_id, {low} AS low, {high} AS high FROM (SELECT image_id, quantile_cont(v, 0.5) AS median FROM {source} GROUP BY image_id)),
{out}_p AS (SELECT m.image_id, m.y, m.x, m.m > t.high AS strong FROM {out}_m AS m JOIN {out}_t AS t USING (image_id)
  LEFT JOIN {out}_m AS b ON b.image_id = m.image_id AND b.y = m.y + m.dy AND b.x = m.x + m.dx LEFT JOIN {out}_m AS c ON c.image_id = m.image_id AND c.y = m.y - m.dy AND c.x = m.x - m.dx
  WHERE m.m > coalesce(b.m, 0) AND m.m >= coalesce(c.m, 0) AND m.m > t.low),
{out}_w AS (SELECT image_id, y, x FROM {out}_p WHERE strong UNION SELECT p.image_id, p.y, p.x FROM {out}_w AS w JOIN {out}_p AS p ON p.image_id = w.image_id AND abs(p.y - w.y) <= 1 AND abs(p.x - w.x) <= 1),
{out} AS (SELECT s.image_id, s.y, s.x, CASE WHEN w.y IS NULL THEN 0 ELSE 255 END AS v FROM {source} AS s LEFT JOIN {out}_w AS w USING (image_id, y, x))"""


def _median_canny(source: str, low: float, high: float, out: str) -> str:
    return _canny_sql(source, f"greatest(0.0::DOUBLE, {DOUBLE(low)} * median)", f"least(255.0::DOUBLE, {DOUBLE(high)} * median)", out)


DISC = ", ".join(f"({dy}, {dx})" for dy in range(-2, 3) for dx in range(-2, 3) if dy * dy + dx * dx <= 4)


def _bilateral_sql(source: str, out: str) -> str:
    mirror = lambda c: f"CASE WHEN {c} < 0 THEN -({c}) WHEN {c} > 7 THEN 14 - ({c}) ELSE {c} END"
    return f"""{out} AS (SELECT image_id, y, x, greatest(0, least(255, round_even(sum(k * u) / sum(k), 0)))::INT AS v FROM (
SELECT a.image_id, a.y, a.x, b.v AS u, exp(-(dy * dy + dx * dx) / 450.0::DOUBLE - (b.v - a.v) * (b.v - a.v) / 1800.0::DOUBLE) AS k FROM {source} AS a, (VALUES {DISC}) AS t(dy, dx), {source} AS b
WHERE b.image_id = a.image_id AND b.y = {mirror("a.y + dy")} AND b.x = {mirror("a.x + dx")}) GROUP BY image_id, y, x)"""


def _heal_sql(source: str, out: str) -> str:
    """Closings of the inverted raster by a cross, a row and a column, inverted back."""
    closed = _steps_sql(out + "_n", out + "_c", *((pick, shape) for shape in (CROSS, FLAT, TALL) for pick in ("max", "min")))
    return f"{out}_n AS (SELECT image_id, y, x, 255 - v AS v FROM {source}), {closed}, {out} AS (SELECT image_id, y, x, 255 - v AS v FROM {out}_c)"


# ---- thresholds -------------------------------------------------------------------------------------------------


@query(with_(PX, OTSU) + "SELECT image_id, t::BIGINT AS t FROM o")
def otsu_threshold(spark, sf_dir):
    return _long(P.otsu(_together(spark, sf_dir)))


@query(with_(PX, OTSU) + "SELECT image_id, y, x, ink FROM ink")
def otsu_mask(spark, sf_dir):
    return P.otsu_ink(_together(spark, sf_dir)).drop("v")


@query(with_(PX, OTSU) + "SELECT image_id, y, x, ink * 255 AS v FROM ink")
def otsu_mask_kernel(spark, sf_dir):
    """The raster kernel, without a shuffle, against the same SQL."""
    return pixel_rows(_rasters(spark, sf_dir), K.ink_otsu)


@query(with_(PX) + "SELECT image_id, y, x, (v > 127)::INT AS on FROM px".replace(" on ", ' "on" '))
def fixed_threshold(spark, sf_dir):
    return _px(spark, sf_dir).select("image_id", "y", "x", (F.col("v") > 127).cast("int").alias("on"))


ADAPTIVE = with_(PX) + """SELECT a.image_id, a.y, a.x, ((a.v + 3) * count(*) <= sum(b.v))::INT AS ink
FROM px AS a, (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx), px AS b
WHERE b.image_id = a.image_id AND b.y = greatest(0, least(7, a.y + dy)) AND b.x = greatest(0, least(7, a.x + dx)) GROUP BY a.image_id, a.y, a.x, a.v"""


@query(ADAPTIVE)
def adaptive_mean_mask(spark, sf_dir):
    return P.adaptive_ink(_together(spark, sf_dir), R.SIDE, 5, 3)


@query(ADAPTIVE.replace("::INT AS ink", "::INT * 255 AS v"))
def adaptive_mean_kernel(spark, sf_dir):
    return pixel_rows(_rasters(spark, sf_dir), lambda x: K.ink_adaptive(x, 5, 3))


@query(with_(PX, OTSU) + "SELECT image_id, coalesce(avg(v) FILTER (WHERE ink = 0), 255) < coalesce(avg(v) FILTER (WHERE ink = 1), 0) AS inverted FROM ink GROUP BY image_id")
def auto_invert(spark, sf_dir):
    """Whether the mask of the bright class would be inverted."""
    return P.auto_invert(P.otsu_ink(_together(spark, sf_dir)).withColumn("bright", 1 - F.col("ink")))


@query(with_(PX, OTSU) + "SELECT image_id, sum(ink)::BIGINT AS ink_pixels, count(*) AS pixels FROM ink GROUP BY image_id")
def fill_ratio(spark, sf_dir):
    return P.otsu_ink(_together(spark, sf_dir)).groupBy("image_id").agg(F.sum("ink").alias("ink_pixels"), F.count("*").alias("pixels"))


def _smooth_sql(size: int, mode: str, source: str = "px", sigma: float = 0.0) -> str:
    """Gaussian means of a pixel table as CTEs that end in sm (image_id, y, x, v, mean); edges mirrored or repeated."""
    place = lambda c: f"greatest(0, least(7, {c}))" if mode == "edge" else f"CASE WHEN {c} < 0 THEN -({c}) WHEN {c} > 7 THEN 14 - ({c}) ELSE {c} END"
    rows = ", ".join(f"({k - size // 2}, {float(w)!r}::DOUBLE)" for k, w in enumerate(K.gaussian_weights(size, sigma)))
    return f"""k1 AS (SELECT * FROM (VALUES {rows}) AS t(d, w)),
sm0 AS (SELECT a.image_id, a.y, a.x, any_value(a.v) AS v, sum(k1.w * b.v) AS m FROM {source} AS a JOIN k1 ON true JOIN {source} AS b ON b.image_id = a.image_id AND b.x = a.x AND b.y = {place("a.y + k1.d")} GROUP BY a.image_id, a.y, a.x),
sm AS (SELECT a.image_id, a.y, a.x, any_value(a.v) AS v, greatest(0, least(255, round_even(sum(k1.w * b.m), 0)))::INT AS mean FROM sm0 AS a JOIN k1 ON true JOIN sm0 AS b ON b.image_id = a.image_id AND b.y = a.y AND b.x = {place("a.x + k1.d")} GROUP BY a.image_id, a.y, a.x)"""


def _polar_sql(source: str, out: str) -> str:
    """A mask (v, on) inverted where its class is the darker one, and its fill."""
    return f"""{out}_i AS (SELECT image_id, coalesce(avg(v) FILTER (WHERE "on"), 255) < coalesce(avg(v) FILTER (WHERE NOT "on"), 0) AS inverted FROM {source} GROUP BY image_id),
{out} AS (SELECT s.image_id, s.y, s.x, s."on" <> i.inverted AS "on", avg((s."on" <> i.inverted)::INT) OVER (PARTITION BY s.image_id) AS fill FROM {source} AS s JOIN {out}_i AS i USING (image_id))"""


CASCADE = with_(PX, _level_sql("px", "o"), 'm1 AS (SELECT px.image_id, y, x, v, v > t AS "on" FROM px JOIN o USING (image_id))', _polar_sql("m1", "p1"), _smooth_sql(21, "edge"),
    'm2 AS (SELECT image_id, y, x, v, v > mean - 5 AS "on" FROM sm)', _polar_sql("m2", "p2"), _median_canny("px", 0.66, 1.33, "e"), _steps_sql("e", "p3", ("max", ROUND5), ("max", ROUND5), ("min", ROUND5), ("min", ROUND5)), recursive=True)


@query(CASCADE + """SELECT image_id, y, x, CASE WHEN p1.fill BETWEEN 0.02::DOUBLE AND 0.98::DOUBLE THEN p1."on"::INT * 255 WHEN p2.fill BETWEEN 0.02::DOUBLE AND 0.98::DOUBLE THEN p2."on"::INT * 255 ELSE p3.v END AS v
FROM p1 JOIN p2 USING (image_id, y, x) JOIN p3 USING (image_id, y, x)""")
def threshold_cascade(spark, sf_dir):
    return pixel_rows(_rasters(spark, sf_dir), lambda x: K.cascade(x, "auto", "auto"))


@query(with_(PX, _smooth_sql(5, "edge")) + "SELECT image_id, y, x, CASE WHEN v > mean - 5 THEN 255 ELSE 0 END AS v FROM sm")
def adaptive_gaussian(spark, sf_dir):
    return pixel_rows(_rasters(spark, sf_dir), lambda x: K.bright_adaptive(x, 5, 5))


# ---- profiles, runs, trims --------------------------------------------------------------------------------------


@query(with_(PX, OTSU, COL) + "SELECT image_id, pos, n AS ink_count, length FROM pr")
def column_profile(spark, sf_dir):
    return P.profile(P.otsu_ink(_together(spark, sf_dir)), "x")


@query(with_(PX, OTSU, COL.replace("x AS pos", "y AS pos")) + "SELECT image_id, pos, n AS ink_count, length FROM pr")
def row_profile(spark, sf_dir):
    return P.profile(P.otsu_ink(_together(spark, sf_dir)), "y")


@query(with_(PX, OTSU, COL, RUNS) + "SELECT * FROM runs")
def ink_runs(spark, sf_dir):
    return P.runs(P.profile(P.otsu_ink(_together(spark, sf_dir)), "x"))


GLYPH = r"""t AS (SELECT doc_id AS image_id, string_split(translate(coalesce(text, ''), chr(13) || chr(10), '  '), '') AS c FROM documents),
q AS (SELECT image_id, unnest(c) AS ch, unnest(range(len(c))) AS p FROM t),
pr AS (SELECT image_id, (p % 64)::INT AS pos, count(*) FILTER (WHERE ch <> ' ' AND ch <> chr(9))::BIGINT AS n, count(*) AS length FROM q WHERE ch <> '' GROUP BY ALL)"""


def _glyph_profile(spark, sf_dir):
    """Ink of each page column from the text itself: whole texts, no row for each character."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("image_id"), F.translate(F.coalesce("text", F.lit("")), "\r\n", "  ").alias("t"))

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            found = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in batch.column(1).to_pylist()]
            n = np.array([len(codes) for codes in found], np.int64)
            owner, codes = np.repeat(np.arange(len(n)), n), np.concatenate(found) if found else np.zeros(0, np.uint32)
            cell = owner * R.PAGE + (np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n)) % R.PAGE
            size = np.bincount(cell, minlength=len(n) * R.PAGE)
            ink = np.bincount(cell[(codes != 32) & (codes != 9)], minlength=len(size))
            used = np.flatnonzero(size)
            key = batch.column(0).take(pa.array(used // R.PAGE))
            yield pa.RecordBatch.from_arrays([key, pa.array((used % R.PAGE).astype(np.int32)), pa.array(ink[used]), pa.array(size[used])], names=["image_id", "pos", "ink_count", "length"])

    return docs.mapInArrow(rows, "image_id long, pos int, ink_count long, length long")


@query(with_(GLYPH) + "SELECT image_id, pos, n AS ink_count, length FROM pr")
def glyph_column_profile(spark, sf_dir):
    return _glyph_profile(spark, sf_dir)


@query(with_(GLYPH, RUNS) + "SELECT * FROM runs")
def glyph_ink_runs(spark, sf_dir):
    return P.runs(_glyph_profile(spark, sf_dir))


def trim_sql(ink: str, pos: str, out: str, detect: tuple[float, float], cut: tuple[float, float], n: str = "8") -> str:
    """The trim of one axis over the table `ink` (image_id, pos, cover): CTEs that end in `out` (image_id, lo, hi)."""
    return f"""{out}_p AS (SELECT image_id, {pos} AS pos, sum(ink) / count(*) AS cover FROM {ink} GROUP BY ALL),
{out}_t AS (SELECT *, max(cover) OVER (PARTITION BY image_id) AS top, count(*) OVER (PARTITION BY image_id) AS n FROM {out}_p),
{out}_a AS (SELECT *, pos - row_number() OVER (PARTITION BY image_id ORDER BY pos) AS island FROM {out}_t WHERE cover > greatest(0.005, 0.01 * top)),
{out}_r AS (SELECT image_id, island, any_value(n) AS n, min(pos) AS s, max(pos) + 1 AS e FROM {out}_a GROUP BY image_id, island),
{out}_b AS (SELECT image_id, any_value(n) AS n, min(s) AS first, max(e) AS last,
  coalesce(min(s) FILTER (WHERE e > round_even(n * {detect[0]}, 0)), max(s)) AS inner_l,
  coalesce(max(e) FILTER (WHERE s < greatest(0, n - round_even(n * {detect[1]}, 0))), max(e)) AS inner_r FROM {out}_r GROUP BY image_id),
{out}_c AS (SELECT image_id, n, least(inner_l, first + trunc((last - first) * {cut[0]}::DOUBLE)) AS l, greatest(last - trunc((last - first) * {cut[1]}::DOUBLE), inner_r) AS r FROM {out}_b),
{out}_d AS (SELECT c.image_id, any_value(c.n) AS n, coalesce(min(pos) FILTER (WHERE pos >= l AND cover > 0.01), any_value(c.n)) AS l,
  coalesce(max(pos) FILTER (WHERE pos < r AND cover > 0.01) + 1, 0) AS r FROM {out}_c AS c JOIN {out}_p USING (image_id) GROUP BY c.image_id),
{out} AS (SELECT image_id, greatest(0, least(n - 1, l))::BIGINT AS lo, greatest(greatest(0, least(n - 1, l)) + 1, least(n, r))::BIGINT AS hi FROM {out}_d)"""


TRIM_X = trim_sql("ink", "x", "tx", (0.25, 0.25), (0.2, 0.2))
TRIM_Y = trim_sql("(SELECT i.* FROM ink AS i JOIN tx USING (image_id) WHERE i.x >= tx.lo AND i.x < tx.hi)", "y", "ty", (0.3, 0.5), (0.2, 0.4))


@query(with_(PX, OTSU, TRIM_X) + "SELECT image_id, lo, hi FROM tx")
def axis_trim(spark, sf_dir):
    how = Trim()
    return each_raster(_rasters(spark, sf_dir), lambda key, x: [(int(key), *G.trim_axis(K.ink_otsu(x), 0, how))], "image_id long, lo long, hi long")


@query(with_(PX, OTSU, TRIM_X, TRIM_Y) + "SELECT tx.image_id, tx.lo AS xl, tx.hi AS xr, ty.lo AS yt, ty.hi AS yb FROM tx JOIN ty USING (image_id)")
def box_trim(spark, sf_dir):
    how = Trim()
    return each_raster(_rasters(spark, sf_dir), lambda key, x: [(int(key), *G.trim_box(K.ink_otsu(x), how))], "image_id long, xl long, xr long, yt long, yb long")


TEXTS = "t AS (SELECT doc_id AS image_id, string_split(translate(coalesce(text, ''), chr(13) || chr(10), '  '), '') AS c, length(coalesce(text, '')) AS n FROM documents)"
PAGES = """q AS (SELECT image_id, unnest(c) AS ch, unnest(range(len(c))) AS p FROM t WHERE n > 0),
px AS (SELECT image_id, (p // 64)::INT AS y, (p % 64)::INT AS x, CASE WHEN ch = ' ' OR ch = chr(9) THEN 255 ELSE 255 - unicode(ch) % 256 END AS v FROM q
  UNION ALL SELECT image_id, (p // 64)::INT AS y, (p % 64)::INT AS x, 255 AS v FROM (SELECT image_id, unnest(range(n, (n + 63) // 64 * 64)) AS p FROM t))"""


@query(with_(TEXTS, PAGES, OTSU, TRIM_X, TRIM_Y) + "SELECT image_id, tx.lo AS xl, tx.hi AS xr, ty.lo AS yt, ty.hi AS yb FROM tx JOIN ty USING (image_id) UNION ALL SELECT image_id, 0, 64, 0, 0 FROM t WHERE n = 0")
def glyph_box_trim(spark, sf_dir):
    how = Trim()
    return each_raster(R.glyph_rasters(spark, sf_dir), lambda key, x: [(int(key), *G.trim_gray(x, how))], "image_id long, xl long, xr long, yt long, yb long")


@query(with_(PX, OTSU, COL, RUNS, """pk AS (SELECT *, "end" - "start" AS size, sum(mass) OVER i AS total, row_number() OVER (PARTITION BY image_id ORDER BY mass DESC, "start") AS by_mass,
  row_number() OVER (PARTITION BY image_id ORDER BY "end" - "start" DESC, "start") AS by_size FROM runs WINDOW i AS (PARTITION BY image_id)),
weak AS (SELECT image_id, mass < total * 0.5 OR size < 8 * 0.3 AS weak FROM pk WHERE by_mass = 1)""") + """SELECT image_id, "start"::BIGINT AS lo, "end"::BIGINT AS hi FROM pk JOIN weak USING (image_id) WHERE CASE WHEN weak THEN by_size ELSE by_mass END = 1""")
def primary_run(spark, sf_dir):
    def rows(key, x):
        cover = K.coverage(K.ink_otsu(x), 0)
        yield int(key), *G.primary_run(cover, K.runs(cover, 0.005))

    return each_raster(_rasters(spark, sf_dir), rows, "image_id long, lo long, hi long")


# ---- borders: W profiles, 50 places of user activity, hold spikes --------------------------------------------------

WAVE = """w0 AS (SELECT user_id AS image_id, (event_id % 50)::INT AS pos, floor(sum(abs(value)))::BIGINT AS mass FROM events GROUP BY ALL),
w1 AS (SELECT u.image_id, p.pos, coalesce(mass, 0) AS mass FROM (SELECT DISTINCT user_id AS image_id FROM events) AS u CROSS JOIN (SELECT unnest(range(50))::INT AS pos) AS p LEFT JOIN w0 ON w0.image_id = u.image_id AND w0.pos = p.pos),
w AS (SELECT *, max(mass) OVER (PARTITION BY image_id) AS top FROM w1)"""


def _waves(spark, sf_dir):
    """(image_id, mass): a 50-place profile of whole numbers for each user. Values are added as the decimals they are
    written as: a sum of doubles depends on the order, and is cut to the number below where it ends just short of one."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null")
    places = events.groupBy(F.col("user_id").alias("image_id"), (F.col("event_id") % 50).alias("pos")).agg(F.floor(F.sum(F.abs("value").cast("decimal(38,18)"))).cast("long").alias("mass"))
    cells = [F.coalesce(F.max(F.when(F.col("pos") == k, F.col("mass"))), F.lit(0).cast("long")) for k in range(50)]
    return places.groupBy("image_id").agg(F.array(*cells).alias("mass"))


SPIKES = """r0 AS (SELECT *, pos - row_number() OVER (PARTITION BY image_id ORDER BY pos) AS island FROM w WHERE top > 0 AND pos < 10 AND mass * 20 >= top * 7),
r1 AS (SELECT image_id, any_value(top) AS top, min(pos) AS s, max(pos) + 1 AS e, sum(mass) AS m FROM r0 GROUP BY image_id, island),
r2 AS (SELECT r1.*, n.after_mass, n.after_n FROM r1, LATERAL (SELECT sum(w.mass) AS after_mass, count(*) AS after_n FROM w WHERE w.image_id = r1.image_id AND w.pos >= r1.e AND w.pos < least(10, 2 * r1.e - r1.s)) AS n WHERE r1.e < 10),
r3 AS (SELECT *, (m * after_n - after_mass * (e - s)) AS drop_num, ((e - s) * after_n) AS den FROM r2)"""


@query(with_(WAVE, SPIKES) + """SELECT image_id, s::BIGINT AS "start", e::BIGINT AS "end", (s <= 4 AND e - s <= 4 AND drop_num * 5 >= top * 2 * den AND drop_num * 2 * (e - s) >= m * den) AS border FROM r3""")
def border_spikes(spark, sf_dir):
    """Runs of high activity in the first fifth of a profile, and which are border spikes. Lengths 1 to 4 of 50."""
    how = Border()

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for key, mass in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cover = np.asarray(mass, np.int64)
                if cover.max(initial=0) > 0:
                    out += [(key, s["start"], s["end"], s["border"]) for s in G.spikes(cover[:10], int(cover.max()), len(cover), how)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["image_id", "start", "end", "border"])

    return _waves(spark, sf_dir).mapInArrow(rows, 'image_id long, start long, end long, border boolean')


def _frames(spark, sf_dir):
    """Stretched rasters with dark frames: framed scans for the border operators."""
    return map_raster(_stretched_rasters(spark, sf_dir), lambda x: np.pad(np.pad(np.kron(x, np.ones((4, 4), np.uint8)), 6, constant_values=255), ((0, 0), (2, 2)), constant_values=0))


#: Framed scans: 4 by 4 pixels for each of a raster, 6 white ones around, two dark columns at either side.
FRAMES = """fr AS (SELECT i.image_id, r.y, c.x, CASE WHEN c.x < 2 OR c.x >= 46 THEN 0 WHEN r.y < 6 OR r.y >= 38 OR c.x < 8 OR c.x >= 40 THEN 255 ELSE p.v END AS v
  FROM (SELECT DISTINCT image_id FROM px) AS i CROSS JOIN (SELECT unnest(range(44))::INT AS y) AS r CROSS JOIN (SELECT unnest(range(48))::INT AS x) AS c
  LEFT JOIN px AS p ON p.image_id = i.image_id AND p.y = (r.y - 6) // 4 AND p.x = (c.x - 8) // 4 AND r.y BETWEEN 6 AND 37 AND c.x BETWEEN 8 AND 39)"""


def _spike_sql(place: str, margin: str, state: str, out: str) -> str:
    """The longest border spike of a margin whose columns `place` counts from the edge of (lo, hi): `out` (image_id, s, e)."""
    return f"""{out}_m AS (SELECT image_id, {place} AS pos, mass, top, {margin} AS margin, hi - lo AS n FROM {state}_c WHERE top > 0 AND {place} < {margin}),
{out}_r AS (SELECT image_id, any_value(top) AS top, any_value(margin) AS margin, any_value(n) AS width, min(pos) AS s, max(pos) + 1 AS e, sum(mass) AS m FROM (SELECT *, pos - row_number() OVER (PARTITION BY image_id ORDER BY pos) AS island FROM {out}_m WHERE mass * 20 >= top * 7) GROUP BY image_id, island),
{out}_a AS (SELECT r.*, a.after, a.n FROM {out}_r AS r, LATERAL (SELECT sum(a.mass) AS after, count(*) AS n FROM {out}_m AS a WHERE a.image_id = r.image_id AND a.pos >= r.e AND a.pos < 2 * r.e - r.s) AS a),
{out} AS (SELECT image_id, s, e FROM {out}_a WHERE e < margin AND s <= 4 AND e - s <= greatest(1, trunc(width * 0.08::DOUBLE)) AND (m * n - after * (e - s)) * 5 >= top * 2 * (e - s) * n AND (m * n - after * (e - s)) * 2 >= m * n
  QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY e - s DESC, s) = 1)"""


def _pass_sql(state: str, out: str) -> str:
    """One pass of border cuts over the columns lo..hi of `state`: `out` (image_id, lo, hi, left_cut, right_cut)."""
    margin = "trunc((hi - lo) * 0.2::DOUBLE)"
    return f"""{state}_c AS (SELECT *, max(mass) OVER (PARTITION BY image_id) AS top FROM (SELECT fr.image_id, x, any_value(lo) AS lo, any_value(hi) AS hi, count(*) FILTER (WHERE v <= t) AS mass FROM fr JOIN o USING (image_id) JOIN {state} AS w ON w.image_id = fr.image_id AND fr.x >= w.lo AND fr.x < w.hi GROUP BY fr.image_id, x)),
{_spike_sql("x - lo", margin, state, out + "_l")}, {_spike_sql("hi - 1 - x", f"CASE WHEN hi - lo < 5 THEN hi - lo ELSE {margin} END", state, out + "_r")},
{out}_k AS (SELECT w.image_id, lo, hi - lo AS n, coalesce(l.e, 0) AS left_cut, coalesce(r.s + 1, 0) AS right_cut FROM {state} AS w LEFT JOIN {out}_l AS l USING (image_id) LEFT JOIN {out}_r AS r USING (image_id)),
{out} AS (SELECT image_id, lo + least(n - 1, left_cut) AS lo, lo + greatest(least(n - 1, left_cut) + 1, n - right_cut) AS hi, left_cut, right_cut FROM {out}_k)"""


START = "b0 AS (SELECT DISTINCT image_id, 0 AS lo, 48 AS hi FROM px)"


@query(with_(ST, FRAMES, _level_sql("fr", "o"), START, _pass_sql("b0", "b1")) + "SELECT image_id, left_cut::INT AS left_cut, right_cut::INT AS right_cut FROM b1")
def border_cuts(spark, sf_dir):
    how = Border()
    return each_raster(_frames(spark, sf_dir), lambda key, x: [(int(key), *G.border_cuts(K.ink_otsu(x), how))], "image_id long, left_cut int, right_cut int")


def _rows_sql(ink: str) -> str:
    """The rows to keep of a mask, as ty (image_id, lo, hi)."""
    return trim_sql(ink, "y", "ty", (0.3, 0.3), (0.5, 0.5)).replace("greatest(0.005, 0.01 * top)", "greatest(0.001, 0.01 * top)").replace("round_even(n * 0.3, 0)", "trunc(n * 0.3)").replace("cover > 0.01", "cover > 0.005")


TRIMMED = with_(ST, FRAMES, _level_sql("fr", "o"), START, *(_pass_sql(f"b{k}", f"b{k + 1}") for k in range(5)),
    _rows_sql("(SELECT fr.image_id, fr.y, (v <= t)::INT AS ink FROM fr JOIN o USING (image_id) JOIN b5 ON b5.image_id = fr.image_id AND fr.x >= b5.lo AND fr.x < b5.hi)"),
    "kept AS (SELECT b5.image_id, b5.lo::INT AS xl, b5.hi::INT AS xr, CASE WHEN b5.lo = 0 AND b5.hi = 48 THEN 0 ELSE coalesce(ty.lo, 0) END::INT AS yt, CASE WHEN b5.lo = 0 AND b5.hi = 48 THEN 44 ELSE coalesce(ty.hi, 44) END::INT AS yb FROM b5 LEFT JOIN ty USING (image_id))")


@query(TRIMMED + "SELECT image_id, xl, xr, yt, yb FROM kept")
def border_trim_iterative(spark, sf_dir):
    how = Border()
    return each_raster(_frames(spark, sf_dir), lambda key, x: [(int(key), *G.trim_border(K.ink_otsu(x), how))], "image_id long, xl int, xr int, yt int, yb int")


@query(with_(PX, OTSU, _rows_sql("ink")) + "SELECT image_id, lo AS yt, hi AS yb FROM ty")
def vertical_bounds(spark, sf_dir):
    how = Border()
    return each_raster(_rasters(spark, sf_dir), lambda key, x: [(int(key), *G.vertical_bounds(K.ink_otsu(x), how))], "image_id long, yt long, yb long")


EFFECT = ("af AS (SELECT fr.image_id, fr.y, fr.x, fr.v AS v0, CASE WHEN fr.x >= xl AND fr.x < xr AND fr.y >= yt AND fr.y < yb THEN fr.v ELSE 255 END AS v FROM fr JOIN kept USING (image_id))", _level_sql("af", "oa"),
    "ef AS (SELECT af.image_id, sum((v0 <= o.t AND v > oa.t)::INT)::BIGINT AS removed_area, sum((v0 <= o.t)::INT)::BIGINT AS total_area FROM af JOIN o USING (image_id) JOIN oa USING (image_id) GROUP BY af.image_id)")


@query(TRIMMED.rstrip() + ", " + ", ".join(EFFECT) + " SELECT *, removed_area / greatest(1, total_area) AS removal_ratio, removed_area > 0 AS has_effect FROM ef")
def border_effect(spark, sf_dir):
    def rows(key, x):
        left, right, top, bottom = G.trim_border(K.ink_otsu(x), Border())
        kept = np.full_like(x, 255)
        kept[top:bottom, left:right] = x[top:bottom, left:right]
        yield int(key), *G.border_effect(x, kept).values()

    return each_raster(_frames(spark, sf_dir), rows, "image_id long, removed_area long, total_area long, removal_ratio double, has_effect boolean")


# ---- components and noise ---------------------------------------------------------------------------------------


def _labels(rasters, mask):
    def rows(key, x):
        labels, _ = K.components(mask(x))
        for y, z in zip(*np.nonzero(labels), strict=True):
            yield int(key), int(labels[y, z]), int(y), int(z)

    return each_raster(rasters, rows, "image_id long, label long, y int, x int")


@query(with_(PX, OTSU, LABEL, recursive=True) + "SELECT image_id, label, y, x FROM lab")
def cc_labels(spark, sf_dir):
    return _labels(_rasters(spark, sf_dir), K.ink_otsu)


STATS = "image_id, label, x::BIGINT AS x, y::BIGINT AS y, w::BIGINT AS w, h::BIGINT AS h, area"


@query(with_(PX, OTSU, LABEL, recursive=True) + f"SELECT {STATS} FROM st")
def cc_stats(spark, sf_dir):
    def rows(key, x):
        for k, s in enumerate(K.components(K.ink_otsu(x))[1], 1):
            yield int(key), k, *map(int, s)

    return each_raster(_rasters(spark, sf_dir), rows, "image_id long, label long, x long, y long, w long, h long, area long")


TIER = ComponentFilter(touch_margin=0, zone_margin=1, touch_ratio=0.04, zone_ratio=0.05, interior_ratio=0.02, max_aspect=4.0, min_dim=1)


@query(with_(PX, OTSU, LABEL, recursive=True) + """SELECT image_id, label, tier, area < CASE tier WHEN 'border_touch' THEN 2 WHEN 'edge_zone' THEN 3 ELSE 1 END
  OR (tier <> 'interior' AND (greatest(w / h, h / w) >= 4 OR least(w, h) <= 1)) AS removed FROM (SELECT *, CASE WHEN x <= 0 OR y <= 0 OR x + w >= 8 OR y + h >= 8 THEN 'border_touch' WHEN x <= 1 OR y <= 1 OR x + w >= 7 OR y + h >= 7 THEN 'edge_zone' ELSE 'interior' END AS tier FROM st)""")
def cc_tier_filter(spark, sf_dir):
    return P.tier(P.component_stats(_labels(_rasters(spark, sf_dir), K.ink_otsu)), 8, 8, TIER).select("image_id", "label", "tier", "removed")


@query(with_(PX, OTSU, LABEL, """tr AS (SELECT *, CASE WHEN x <= 0 OR y <= 0 OR x + w >= 8 OR y + h >= 8 THEN 'border_touch' WHEN x <= 1 OR y <= 1 OR x + w >= 7 OR y + h >= 7 THEN 'edge_zone' ELSE 'interior' END AS tier FROM st),
ok AS (SELECT image_id, label FROM tr WHERE NOT (area < CASE tier WHEN 'border_touch' THEN 2 WHEN 'edge_zone' THEN 3 ELSE 1 END OR (tier <> 'interior' AND (greatest(w / h, h / w) >= 4 OR least(w, h) <= 1))))""", recursive=True) + "SELECT px.image_id, px.y, px.x, CASE WHEN ok.label IS NULL THEN 0 ELSE 255 END AS v FROM px LEFT JOIN lab USING (image_id, y, x) LEFT JOIN ok ON ok.image_id = px.image_id AND ok.label = lab.label")
def cc_filtered_mask(spark, sf_dir):
    return pixel_rows(_rasters(spark, sf_dir), lambda x: G.filter_components(K.ink_otsu(x), TIER))


@query(with_(PX, OTSU, LABEL, recursive=True) + "SELECT image_id, label, area FROM st WHERE area >= 6")
def keep_large(spark, sf_dir):
    return P.component_stats(_labels(_rasters(spark, sf_dir), K.ink_otsu)).where("area >= 6").select("image_id", "label", "area")


@query(with_(PX, OTSU, LABEL, recursive=True) + "SELECT image_id, label, area FROM st QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY area DESC, label) = 1")
def biggest_component(spark, sf_dir):
    return P.largest(P.component_stats(_labels(_rasters(spark, sf_dir), K.ink_otsu)))


LIGHT = "ink AS (SELECT image_id, y, x, v, (v > 60 AND v < 230)::INT AS ink FROM px)"
NOISE = Noise(least_area=2, large_area=12, max_aspect=3.0, slender_area=8)


@query(with_(ST, LIGHT, LABEL, recursive=True) + f"SELECT {STATS}, area BETWEEN 2 AND 100000 AND (area > 12 OR (greatest(w, h) / least(w, h) > 3 AND area < 8)) AS noise FROM st")
def noise_components(spark, sf_dir):
    light = _labels(_stretched_rasters(spark, sf_dir), lambda x: (x > NOISE.dark) & (x < NOISE.light))
    return _long(P.noise(P.component_stats(light), NOISE))


@query(with_(ST, LIGHT, LABEL, """hw AS (SELECT unnest([-3, -2, -1, 0, 1, 2, 3]) AS dy, unnest([0, 2, 3, 3, 3, 2, 0]) AS half),
ring AS (SELECT DISTINCT l.image_id, l.label, p.y, p.x, p.v FROM lab AS l JOIN hw ON true JOIN px AS p ON p.image_id = l.image_id AND p.y = l.y + dy AND abs(p.x - l.x) <= half
  WHERE NOT EXISTS (SELECT 1 FROM lab AS o WHERE o.image_id = l.image_id AND o.label = l.label AND o.y = p.y AND o.x = p.x)),
med AS (SELECT image_id, label, trunc(quantile_cont(v, 0.5))::BIGINT AS background FROM ring GROUP BY ALL),
every AS (SELECT st.image_id, st.label, trunc(quantile_cont(v, 0.5))::BIGINT AS background FROM st JOIN px ON px.image_id = st.image_id AND px.y BETWEEN st.y - 3 AND st.y + st.h + 2 AND px.x BETWEEN st.x - 3 AND st.x + st.w + 2 GROUP BY ALL)""", recursive=True) + "SELECT every.image_id, every.label, coalesce(med.background, every.background) AS background FROM every LEFT JOIN med USING (image_id, label)")
def local_background(spark, sf_dir):
    """Of every light component, with a ring of radius 3."""

    def rows(key, x):
        labels, stats = K.components((x > 60) & (x < 230))
        for k in range(1, len(stats) + 1):
            yield int(key), k, K.local_background(x, labels == k, 3)

    return each_raster(_stretched_rasters(spark, sf_dir), rows, "image_id long, label long, background long")


@query(with_(ST, LIGHT, LABEL, """hw AS (SELECT unnest(range(-5, 6)) AS dy, unnest([0, 3, 4, 5, 5, 5, 5, 5, 4, 3, 0]) AS half),
bad AS (SELECT image_id, label, x, y, w, h FROM st WHERE area BETWEEN 2 AND 100000 AND (area > 12 OR (greatest(w, h) / least(w, h) > 3 AND area < 8))),
ring AS (SELECT DISTINCT l.image_id, l.label, p.y, p.x, p.v FROM lab AS l JOIN bad USING (image_id, label) JOIN hw ON true JOIN px AS p ON p.image_id = l.image_id AND p.y = l.y + dy AND abs(p.x - l.x) <= half
  WHERE NOT EXISTS (SELECT 1 FROM lab AS o WHERE o.image_id = l.image_id AND o.label = l.label AND o.y = p.y AND o.x = p.x)),
med AS (SELECT image_id, label, trunc(quantile_cont(v, 0.5))::INT AS background FROM ring GROUP BY ALL),
every AS (SELECT bad.image_id, bad.label, trunc(quantile_cont(v, 0.5))::INT AS background FROM bad JOIN px ON px.image_id = bad.image_id AND px.y BETWEEN bad.y - 5 AND bad.y + bad.h + 4 AND px.x BETWEEN bad.x - 5 AND bad.x + bad.w + 4 GROUP BY ALL),
bg AS (SELECT image_id, label, coalesce(med.background, every.background) AS background FROM every LEFT JOIN med USING (image_id, label))""", recursive=True) + "SELECT px.image_id, px.y, px.x, coalesce(bg.background, px.v) AS v FROM px LEFT JOIN lab USING (image_id, y, x) LEFT JOIN bg ON bg.image_id = px.image_id AND bg.label = lab.label")
def noise_removed(spark, sf_dir):
    return pixel_rows(_stretched_rasters(spark, sf_dir), lambda x: G.remove_noise(x, NOISE))


def _parts_sql(source: str, on: str, out: str) -> str:
    """8-connected parts of the pixels that meet a condition: `out` (image_id, y, x, v, label) and `out`_s, their boxes."""
    return f"""{out}_p AS ({on}), {out}_w AS (SELECT image_id, y * 8 + x AS root, y, x FROM {out}_p
  UNION SELECT w.image_id, w.root, p.y, p.x FROM {out}_w AS w JOIN {out}_p AS p ON p.image_id = w.image_id AND abs(p.y - w.y) <= 1 AND abs(p.x - w.x) <= 1 WHERE w.root <= p.y * 8 + p.x),
{out} AS (SELECT w.image_id, w.y, w.x, any_value(s.v) AS v, min(w.root) AS label FROM {out}_w AS w JOIN {source} AS s USING (image_id, y, x) GROUP BY w.image_id, w.y, w.x),
{out}_s AS (SELECT image_id, label, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area, avg(v) AS mean, stddev_pop(v) AS spread FROM {out} GROUP BY ALL)"""


def _painted_sql(source: str, parts: str, bad: str, out: str) -> str:
    """Parts named by `bad` (image_id, label) painted with the median of the ring of radius 5 around them."""
    return f"""{out}_h AS (SELECT unnest(range(-5, 6)) AS dy, unnest([0, 3, 4, 5, 5, 5, 5, 5, 4, 3, 0]) AS half), {out}_b AS (SELECT s.* FROM {parts}_s AS s JOIN {bad} USING (image_id, label)),
{out}_r AS (SELECT DISTINCT l.image_id, l.label, p.y, p.x, p.v FROM {parts} AS l JOIN {bad} USING (image_id, label) JOIN {out}_h ON true JOIN {source} AS p ON p.image_id = l.image_id AND p.y = l.y + dy AND abs(p.x - l.x) <= half
  WHERE NOT EXISTS (SELECT 1 FROM {parts} AS o WHERE o.image_id = l.image_id AND o.label = l.label AND o.y = p.y AND o.x = p.x)),
{out}_m AS (SELECT image_id, label, trunc(quantile_cont(v, 0.5))::INT AS ground FROM {out}_r GROUP BY ALL),
{out}_e AS (SELECT b.image_id, b.label, trunc(quantile_cont(s.v, 0.5))::INT AS ground FROM {out}_b AS b JOIN {source} AS s ON s.image_id = b.image_id AND s.y BETWEEN b.y - 5 AND b.y + b.h + 4 AND s.x BETWEEN b.x - 5 AND b.x + b.w + 4 GROUP BY ALL),
{out}_g AS (SELECT e.image_id, e.label, coalesce(m.ground, e.ground) AS ground FROM {out}_e AS e LEFT JOIN {out}_m AS m USING (image_id, label)),
{out} AS (SELECT s.image_id, s.y, s.x, coalesce(g.ground, s.v) AS v FROM {source} AS s LEFT JOIN {parts} AS l USING (image_id, y, x) LEFT JOIN {out}_g AS g ON g.image_id = l.image_id AND g.label = l.label)"""


def _dual_sql(least: int, most: int, out: str, strict: float = 0.7, loose: float = 1.2, verify: bool = True) -> str:
    """Parts between two multiples of Otsu's threshold, if asked only those that look like noise: edges of each part's
    mask give its rim."""
    return ", ".join((
        _level_sql("px", "o"),
        _parts_sql("px", f"SELECT px.* FROM px JOIN o USING (image_id) WHERE v <= trunc(t * {DOUBLE(loose)}) AND v > trunc(t * {DOUBLE(strict)})", "part"),
        f"sized AS (SELECT * FROM part_s WHERE area BETWEEN {least} AND {most})",
        "lone AS (SELECT sized.image_id * 64 + sized.label AS image_id, px.y, px.x, CASE WHEN part.label IS NULL THEN 0 ELSE 255 END AS v FROM sized JOIN px USING (image_id) LEFT JOIN part ON part.image_id = px.image_id AND part.y = px.y AND part.x = px.x AND part.label = sized.label)",
        _canny_sql("lone", "50", "150", "rim"),
        "rims AS (SELECT image_id // 64 AS image_id, image_id % 64 AS label, sum(v // 255) AS rim FROM rim GROUP BY ALL)",
        f"""bad AS (SELECT image_id, label FROM sized JOIN rims USING (image_id, label) WHERE {not verify} OR greatest(w, h) / least(w, h) > 8 OR CASE WHEN rim = 0 THEN 0 ELSE 4 * pi() * area / (rim * rim) END < 0.1::DOUBLE OR (mean > 180 AND spread < 20))""",
        _painted_sql("px", "part", "bad", out),
    ))


@query(with_(ST, _dual_sql(2, 57, "out"), recursive=True) + "SELECT image_id, y, x, v FROM out")
def noise_removed_dual(spark, sf_dir):
    return pixel_rows(_stretched_rasters(spark, sf_dir), lambda x: G.remove_noise_dual(x, least=2, most=0.9))


BAND = """hw AS (SELECT unnest(range(-5, 6)) AS dy, unnest([0, 3, 4, 5, 5, 5, 5, 5, 4, 3, 0]) AS half),
bad AS (SELECT image_id, label, x, y, w, h FROM st WHERE area >= 2),
ring AS (SELECT DISTINCT l.image_id, l.label, p.y, p.x, p.v FROM lab AS l JOIN bad USING (image_id, label) JOIN hw ON true JOIN px AS p ON p.image_id = l.image_id AND p.y = l.y + dy AND abs(p.x - l.x) <= half
  WHERE NOT EXISTS (SELECT 1 FROM lab AS o WHERE o.image_id = l.image_id AND o.label = l.label AND o.y = p.y AND o.x = p.x)),
med AS (SELECT image_id, label, trunc(quantile_cont(v, 0.5))::INT AS background FROM ring GROUP BY ALL),
every AS (SELECT bad.image_id, bad.label, trunc(quantile_cont(v, 0.5))::INT AS background FROM bad JOIN px ON px.image_id = bad.image_id AND px.y BETWEEN bad.y - 5 AND bad.y + bad.h + 4 AND px.x BETWEEN bad.x - 5 AND bad.x + bad.w + 4 GROUP BY ALL),
bg AS (SELECT image_id, label, coalesce(med.background, every.background) AS background FROM every LEFT JOIN med USING (image_id, label))"""


@query(with_(ST, "ink AS (SELECT image_id, y, x, v, (v BETWEEN 150 AND 220)::INT AS ink FROM px)", LABEL, BAND, recursive=True) + "SELECT px.image_id, px.y, px.x, coalesce(bg.background, px.v) AS v FROM px LEFT JOIN lab USING (image_id, y, x) LEFT JOIN bg ON bg.image_id = px.image_id AND bg.label = lab.label")
def noise_removed_band(spark, sf_dir):
    return pixel_rows(_stretched_rasters(spark, sf_dir), lambda x: G.remove_noise_band(x, (150, 220), 2))


@query(with_(ST, _dual_sql(2, 57, "out", verify=False), recursive=True) + "SELECT image_id, y, x, v FROM out")
def noise_removed_dual_any_shape(spark, sf_dir):
    """Without the test of shape, which few parts of rasters as small as these fail."""
    return pixel_rows(_stretched_rasters(spark, sf_dir), lambda x: G.remove_noise_dual(x, least=2, most=0.9, verify=False))


@query(with_(ST, _dual_sql(2, 57, "out", 1.0, 1.9), recursive=True) + "SELECT image_id, y, x, v FROM out")
def noise_removed_dual_light(spark, sf_dir):
    """Parts above the threshold, of which the light and even ones go."""
    return pixel_rows(_stretched_rasters(spark, sf_dir), lambda x: G.remove_noise_dual(x, 1.0, 1.9, 2, 0.9))


@query(with_(ST, _dual_sql(5, 6, "mid"), _parts_sql("mid", "SELECT * FROM mid WHERE v BETWEEN 150 AND 220", "band"), "worse AS (SELECT image_id, label FROM band_s WHERE area >= 5)", _painted_sql("mid", "band", "worse", "out"), recursive=True) + "SELECT image_id, y, x, v FROM out")
def noise_removed_hybrid(spark, sf_dir):
    return pixel_rows(_stretched_rasters(spark, sf_dir), G.remove_noise_hybrid)


# ---- morphology, filters, edges ---------------------------------------------------------------------------------


def _around(source: str, pick: str, out: str) -> str:
    return f"{out} AS (SELECT a.image_id, a.y, a.x, {pick}(b.v) AS v FROM {source} AS a JOIN {source} AS b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.image_id, a.y, a.x)"


SQUARE = K.element(3, "rect")


@query(with_(PX, _around("px", "max", "d")) + "SELECT * FROM d")
def dilate3(spark, sf_dir):
    return pixel_rows(_rasters(spark, sf_dir), lambda x: K.dilate(x, SQUARE))


@query(with_(PX, _around("px", "min", "e")) + "SELECT * FROM e")
def erode3(spark, sf_dir):
    return pixel_rows(_rasters(spark, sf_dir), lambda x: K.erode(x, SQUARE))


@query(with_(PX, _around("px", "max", "d")) + "SELECT * FROM d")
def dilate3_pixels(spark, sf_dir):
    """The pixel-table form."""
    return P.extreme3(_together(spark, sf_dir), "v", True)


@query(with_(PX, _around("px", "max", "d"), _around("d", "min", "c")) + "SELECT * FROM c")
def close3(spark, sf_dir):
    return pixel_rows(_rasters(spark, sf_dir), lambda x: K.close(x, SQUARE))


@query(with_(PX, _around("px", "min", "d"), _around("d", "max", "c")) + "SELECT * FROM c")
def open3(spark, sf_dir):
    return pixel_rows(_rasters(spark, sf_dir), lambda x: K.open_(x, SQUARE))


@query(with_(PX, _around("px", "max", "d"), _around("d", "min", "c")) + "SELECT c.image_id, c.y, c.x, greatest(0, c.v - px.v) AS v FROM c JOIN px USING (image_id, y, x)")
def blackhat3(spark, sf_dir):
    return pixel_rows(_rasters(spark, sf_dir), lambda x: K.blackhat(x, SQUARE))


@query(with_(ST, _bilateral_sql("px", "soft"), _heal_sql("soft", "out")) + "SELECT image_id, y, x, v FROM out")
def stroke_heal(spark, sf_dir):
    return pixel_rows(_stretched_rasters(spark, sf_dir), lambda x: K.heal(x, smooth=True))


@query(with_(ST, _around("px", "max", "d"), _around("d", "min", "c"), "kept AS (SELECT px.image_id, px.y, px.x, greatest(0, px.v - round_even(greatest(0, c.v - px.v) * 0.6::DOUBLE, 0))::INT AS v FROM px JOIN c USING (image_id, y, x))", _smooth_sql(7, "reflect", "kept", 1.0))
       + "SELECT image_id, y, x, greatest(0, least(255, round_even(v * 1.2::DOUBLE - mean * 0.2::DOUBLE, 0)))::INT AS v FROM sm")
def ink_kept(spark, sf_dir):
    """Strokes darkened by their black-hat, then sharpened."""
    return pixel_rows(_stretched_rasters(spark, sf_dir), lambda x: K.keep_ink(x, 3, 0.6, 0.2))


@query(with_(ST, _level_sql("px", "o"), "b AS (SELECT px.image_id, y, x, CASE WHEN v > t THEN 255 ELSE 0 END AS v FROM px JOIN o USING (image_id))", _steps_sql("b", "out", ("max", CROSS), ("max", CROSS), ("min", CROSS), ("min", CROSS), ("min", CROSS), ("max", CROSS))) + "SELECT image_id, y, x, v FROM out")
def morph_cleanup(spark, sf_dir):
    return pixel_rows(_stretched_rasters(spark, sf_dir), lambda x: K.cleanup(K.bright_otsu(x), 3, 3))


SOBEL = with_(PX, _stencil_sql(GX, "gx"), _stencil_sql(GY, "gy")) + "SELECT gx.image_id, gx.y, gx.x, gx.n * gx.n + gy.n * gy.n AS mag2 FROM gx JOIN gy USING (image_id, y, x)"


@query(SOBEL)
def sobel_mag2(spark, sf_dir):
    both = P.stencils(_together(spark, sf_dir), R.SIDE, {"gx": GX, "gy": GY})
    return both.select("image_id", "y", "x", (F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("mag2"))


@query(SOBEL)
def sobel_mag2_kernel(spark, sf_dir):
    def kernel(x):
        gx, gy = K.sobel(x)
        return gx * gx + gy * gy

    return _long(pixel_rows(_rasters(spark, sf_dir), kernel, "mag2")).withColumns({"y": F.col("y").cast("int"), "x": F.col("x").cast("int")})


@query(with_(PX, _stencil_sql(LAP, "l")) + "SELECT image_id, y, x, abs(n) AS lap FROM l")
def laplacian_abs(spark, sf_dir):
    return P.stencil(_together(spark, sf_dir), 8, LAP, "lap").withColumn("lap", F.abs("lap"))


@query(with_(PX, _smooth_sql(5, "reflect")) + "SELECT image_id, y, x, mean AS v FROM sm")
def gaussian_blur(spark, sf_dir):
    return pixel_rows(_rasters(spark, sf_dir), lambda x: K.gaussian(x, 5))


@query(with_(PX, _bilateral_sql("px", "out")) + "SELECT image_id, y, x, v FROM out")
def bilateral(spark, sf_dir):
    return pixel_rows(_rasters(spark, sf_dir), lambda x: K.bilateral(x, 5, 30, 15))


@query(with_(ST, _median_canny("px", 0.66, 1.33, "e"), recursive=True) + "SELECT image_id, y, x, v FROM e")
def canny(spark, sf_dir):
    return pixel_rows(_stretched_rasters(spark, sf_dir), lambda x: K.canny_median(x, 0.66, 1.33))


def _stretch_sql(source: str, value: str, out: str) -> str:
    """A column stretched to 0..255, then what is above Otsu's threshold of that."""
    return f"""{out}_v AS (SELECT image_id, y, x, CASE WHEN high = low THEN 0 ELSE trunc((u - low) * (255.0::DOUBLE / (high - low)) + 1e-9)::INT END AS v
  FROM (SELECT *, min(u) OVER w AS low, max(u) OVER w AS high FROM (SELECT image_id, y, x, ({value})::DOUBLE AS u FROM {source}) WINDOW w AS (PARTITION BY image_id))),
{_level_sql(out + "_v", out + "_o")}, {out} AS (SELECT image_id, y, x, v > t AS "on" FROM {out}_v JOIN {out}_o USING (image_id))"""


FUSION = with_(COLOUR, "px AS (SELECT image_id, y, x, ((299 * r + 587 * g + 114 * b + 500) // 1000)::INT AS v FROM cpx)", _smooth_sql(3, "reflect"), "s AS (SELECT image_id, y, x, mean AS v FROM sm)",
    _median_canny("s", 1 - 0.33, 1 + 0.33, "e"), "sg AS (SELECT a.image_id, a.y, a.x, a.n AS gx, b.n AS gy FROM e_gx AS a JOIN e_gy AS b USING (image_id, y, x))", _stretch_sql("sg", "sqrt((gx * gx + gy * gy)::DOUBLE)", "so"),
    _stencil_sql(LAP, "la", "s"), _stretch_sql("la", "abs(n)", "lo"), """f AS (SELECT image_id, y, x, CASE WHEN e.v > 0 OR so."on" OR lo."on" THEN 255 ELSE 0 END AS v FROM e JOIN so USING (image_id, y, x) JOIN lo USING (image_id, y, x))""",
    _steps_sql("f", "out", ("max", CROSS), ("min", CROSS)), recursive=True)


@query(FUSION + "SELECT image_id, y, x, v FROM out")
def edges_fusion(spark, sf_dir):
    return pixel_rows(R.colour_rasters(spark, sf_dir), lambda x: K.texture_edges(x, "fusion"))


def _clahe_sql(source: str, out: str) -> str:
    """Two by two tiles of 4 by 4: with clips below 32 counts are cut at 1, so a tile's table needs its distinct values only."""
    return f"""{out}_t AS (SELECT image_id, y // 4 AS ty, x // 4 AS tx, v FROM {source} GROUP BY ALL), {out}_n AS (SELECT image_id, ty, tx, 16 - count(*) AS over FROM {out}_t GROUP BY ALL),
{out}_q AS (SELECT image_id, y, x, v, (y + 0.5::DOUBLE) / 4 - 0.5::DOUBLE AS py, (x + 0.5::DOUBLE) / 4 - 0.5::DOUBLE AS pz FROM {source}),
{out}_r AS (SELECT q.*, dy, dz, CASE dy WHEN 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END * CASE dz WHEN 1 THEN pz - floor(pz) ELSE 1 - (pz - floor(pz)) END AS share,
  greatest(0, least(1, floor(py) + dy)) AS ty, greatest(0, least(1, floor(pz) + dz)) AS tx FROM {out}_q AS q, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS c(dy, dz)),
{out}_k AS (SELECT r.image_id, r.y, r.x, r.dy, r.dz, any_value(r.share) AS share, greatest(0, least(255, round_even((count(t.v) + any_value(n.over) * (any_value(r.v) + 1) / 256.0::DOUBLE) * 15.9375::DOUBLE, 0))) AS u
  FROM {out}_r AS r JOIN {out}_n AS n ON n.image_id = r.image_id AND n.ty = r.ty AND n.tx = r.tx LEFT JOIN {out}_t AS t ON t.image_id = r.image_id AND t.ty = r.ty AND t.tx = r.tx AND t.v <= r.v GROUP BY r.image_id, r.y, r.x, r.dy, r.dz),
{out} AS (SELECT image_id, y, x, round_even(sum(share * u), 0)::INT AS v FROM {out}_k GROUP BY image_id, y, x)"""


@query(with_(PX, _clahe_sql("px", "out")) + "SELECT image_id, y, x, v FROM out")
def clahe(spark, sf_dir):
    return pixel_rows(_rasters(spark, sf_dir), lambda x: K.clahe(x, 2.0, 2))


U8 = lambda e: f"greatest(0, least(255, round_even({e}, 0)))::INT"
ENHANCE = with_(COLOUR, f"""y0 AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS l FROM cpx),
px AS (SELECT image_id, y, x, {U8("l")} AS v, {U8("(r - l) * 0.713::DOUBLE + 128")} AS cr, {U8("(b - l) * 0.564::DOUBLE + 128")} AS cb FROM y0)""", _clahe_sql("px", "eq"), f"""
rgb AS (SELECT e.image_id, e.y, e.x, {U8("e.v + 1.773::DOUBLE * (cb - 128)")} AS b, {U8("e.v - 0.714::DOUBLE * (cr - 128) - 0.344::DOUBLE * (cb - 128)")} AS g, {U8("e.v + 1.403::DOUBLE * (cr - 128)")} AS r FROM eq AS e JOIN px USING (image_id, y, x)),
top AS (SELECT *, greatest(b, g, r) AS v, greatest(b, g, r) - least(b, g, r) AS d FROM rgb),
hue AS (SELECT *, CASE WHEN d = 0 THEN 0.0::DOUBLE WHEN v = r THEN (g - b) / d::DOUBLE * 60 WHEN v = g THEN (2 + (b - r) / d::DOUBLE) * 60 ELSE (4 + (r - g) / d::DOUBLE) * 60 END AS w, CASE WHEN v = 0 THEN 0 ELSE {U8("d / v::DOUBLE * 255")} END AS s0 FROM top),
hsv AS (SELECT image_id, y, x, (round_even(CASE WHEN w < 0 THEN w + 360 ELSE w END / 2, 0)::INT % 180) / 30.0::DOUBLE AS h, trunc(least(255, s0 * 1.2::DOUBLE)) / 255.0::DOUBLE AS s, v FROM hue),
part AS (SELECT *, floor(h)::INT % 6 AS k, v * (1 - s) AS p, v * (1 - s * (h - floor(h))) AS q, v * (1 - s * (1 - (h - floor(h)))) AS t FROM hsv),
vivid AS (SELECT image_id, y, x, {U8("CASE k WHEN 0 THEN v WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE v END")} AS r,
  {U8("CASE k WHEN 0 THEN t WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q ELSE p END")} AS g, {U8("CASE k WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN v WHEN 4 THEN v ELSE q END")} AS b FROM part),
lit AS (SELECT image_id, y, x, trunc(pow(r / 255.0::DOUBLE, 1.0::DOUBLE / 1.2::DOUBLE) * 255)::INT AS r, trunc(pow(g / 255.0::DOUBLE, 1.0::DOUBLE / 1.2::DOUBLE) * 255)::INT AS g, trunc(pow(b / 255.0::DOUBLE, 1.0::DOUBLE / 1.2::DOUBLE) * 255)::INT AS b FROM vivid)""")  # fmt: skip


@query(ENHANCE + "SELECT image_id, y, x, ((299 * r + 587 * g + 114 * b + 500) // 1000)::INT AS v FROM lit")
def enhance(spark, sf_dir):
    return pixel_rows(R.colour_rasters(spark, sf_dir), lambda x: K.gray(K.enhance(x, tiles=2, gamma=1.2)))


@query(with_(PX, OTSU, """all10 AS (SELECT v.image_id, y::INT AS y, x::INT AS x FROM (SELECT DISTINCT image_id FROM px) AS v, (SELECT unnest(range(10)) AS y), (SELECT unnest(range(10)) AS x)),
pad AS (SELECT a.image_id, a.y, a.x, coalesce(i.ink, 0) AS ink FROM all10 AS a LEFT JOIN ink AS i ON i.image_id = a.image_id AND i.y = a.y - 1 AND i.x = a.x - 1),
far AS (SELECT a.image_id, a.y, a.x, greatest(abs(a.y - b.y), abs(a.x - b.x)) AS l, least(abs(a.y - b.y), abs(a.x - b.x)) AS s FROM pad AS a JOIN pad AS b ON a.image_id = b.image_id AND b.ink = 0)""") + "SELECT image_id, y, x, round_even(min((l - s) * 0.955::DOUBLE + s * 1.3693::DOUBLE) * 1000, 0)::INT AS v FROM far GROUP BY image_id, y, x")
def distance_map(spark, sf_dir):
    return pixel_rows(_rasters(spark, sf_dir), lambda x: np.rint(K.distance(np.pad(K.ink_otsu(x), 1)) * 1000))


#: Erosions by a cross leave what is farther than their number from blank pixels.
SKELETON = with_(PX, OTSU, """far AS (SELECT a.image_id, a.y, a.x, coalesce(min(abs(a.y - b.y) + abs(a.x - b.x)), 99) AS d FROM ink AS a LEFT JOIN ink AS b ON b.image_id = a.image_id AND b.ink = 0 GROUP BY a.image_id, a.y, a.x),
near AS (SELECT a.image_id, a.y, a.x, any_value(a.d) AS d, max(b.d) AS top FROM far AS a JOIN far AS b ON b.image_id = a.image_id AND abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY a.image_id, a.y, a.x)""")


@query(SKELETON + "SELECT image_id, y, x, CASE WHEN d > 0 AND top <= d AND d < 99 THEN 255 ELSE 0 END AS v FROM near")
def skeleton(spark, sf_dir):
    return pixel_rows(_rasters(spark, sf_dir), lambda x: K.skeleton(K.ink_otsu(x)))


@query()
def weak_connections(spark, sf_dir):
    return pixel_rows(_rasters(spark, sf_dir), lambda x: K.break_weak(np.pad(K.ink_otsu(x), 1), 2, 0.9, 3))


# ---- contours ---------------------------------------------------------------------------------------------------

SMALL = ContourJob(method="otsu", bilateral=False, morph=False, keep_biggest=True, min_area=0.0, enhance=False)


@query()
def contours_svg(spark, sf_dir):
    return jobs.extract_contours(R.colour_rasters(spark, sf_dir), SMALL).select("image_id", "fill", F.size("contours").alias("n_contours"), "svg")


@query()
def contours_simplified(spark, sf_dir):
    from dataclasses import replace

    return jobs.extract_contours(R.colour_rasters(spark, sf_dir), replace(SMALL, chain="simple", simplify=0.05, external=False)).select("image_id", F.expr("aggregate(contours, 0L, (a, c) -> a + size(c.points))").alias("n_points"))


@query(FUSION + "SELECT image_id::VARCHAR AS image_id, string_agg(CASE WHEN v > 0 THEN 'FF' ELSE '00' END, '' ORDER BY y, x) AS edges FROM out GROUP BY image_id")
def texture_job(spark, sf_dir):
    return jobs.extract_texture(R.colour_rasters(spark, sf_dir), TextureJob(enhance=False)).select("image_id", F.hex("data").alias("edges"))


@query("SELECT c_custkey AS id, (c_nationkey + 2) * (c_custkey % 7 + 1) / 1.0::DOUBLE AS area, 'M ' || c_nationkey || ' 0 L ' || (2 * c_nationkey + 2) || ' 0 L ' || (2 * c_nationkey + 2) || ' ' || (c_custkey % 7 + 1) || ' L ' || c_nationkey || ' ' || (c_custkey % 7 + 1) || ' Z' AS path FROM customer")
def polygon_area(spark, sf_dir):
    """Areas and SVG paths of rectangles that are made of two columns."""
    n, h = F.col("c_nationkey"), (F.col("c_custkey") % 7 + 1).cast("int")
    point = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    zero = F.lit(0)
    points = F.array(point(n, zero), point(2 * n + 2, zero), point(2 * n + 2, h), point(n, h))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), points.alias("p"))
    return c.select("id", B.polygon_area(F.col("p")).alias("area"), S.svg_path(F.col("p")).alias("path"))


@query("SELECT c_custkey AS id, 4 AS n_points, ((c_nationkey + 2) * (c_custkey % 7 + 1))::DOUBLE AS area FROM customer")
def convex_hulls(spark, sf_dir):
    """Hulls of rectangles with their middles among the points."""
    import pyarrow as pa

    def rows(batches):
        for batch in batches:
            ids, ns, hs = (batch.column(i).to_pylist() for i in range(3))
            hulls = [K.hull([(0, 0), (n + 2, 0), (n + 2, h), (0, h), (1, h), ((n + 2) / 2, h / 2)]) for n, h in zip(ns, hs, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in hulls], pa.int32()), pa.array([K.area(x) for x in hulls], pa.float64())], names=["id", "n_points", "area"])

    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", F.col("c_custkey") % 7 + 1)
    return c.mapInArrow(rows, "id long, n_points int, area double")


# ---- boxes ------------------------------------------------------------------------------------------------------

BOXES = "b AS (SELECT event_id AS id, user_id, (event_id % 97) / 100.0::DOUBLE AS nx, (event_id % 89) / 100.0::DOUBLE AS ny, (event_id % 53) / 100.0::DOUBLE AS nw, (event_id % 61) / 100.0::DOUBLE AS nh FROM events)"
ROUND = lambda e: f"round_even({e}, 0)::INT"
PIXBOX = f"""c AS (SELECT *, greatest(0, least(199, {ROUND("nx * 200")})) AS x, greatest(0, least(99, {ROUND("(1.0::DOUBLE - ny - nh) * 100")})) AS y FROM b),
d AS (SELECT *, greatest(1, least(200 - x, {ROUND("nw * 200")})) AS w, greatest(1, least(100 - y, {ROUND("nh * 100")})) AS h FROM c)"""


def _boxes(spark, sf_dir):
    """Normalised boxes made of event numbers, in images of 200 by 100."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    part = lambda k: (F.col("event_id") % k) / 100.0
    return e.select(F.col("event_id").alias("id"), "user_id", part(97).alias("nx"), part(89).alias("ny"), part(53).alias("nw"), part(61).alias("nh"))


def _pixel_boxes(spark, sf_dir):
    n = [F.col(c) for c in ("nx", "ny", "nw", "nh")]
    return _boxes(spark, sf_dir).withColumns(B.denormalise(*n, F.lit(200), F.lit(100)))


@query(with_(BOXES, PIXBOX) + "SELECT id, x, y, w, h FROM d")
def denormalise_boxes(spark, sf_dir):
    return _pixel_boxes(spark, sf_dir).select("id", "x", "y", "w", "h")


@query(with_(BOXES, PIXBOX) + "SELECT id, greatest(0, x - 2) AS x1, greatest(0, y - 4) AS y1, least(200, x + w + 2) AS x2, least(100, y + h + 2) AS y2 FROM d")
def expand_boxes(spark, sf_dir):
    c = [F.col(k) for k in ("x", "y", "w", "h")]
    return _pixel_boxes(spark, sf_dir).withColumns(B.expand(*c, F.lit(200), F.lit(100))).select("id", "x1", "y1", "x2", "y2")


@query("""SELECT id, x1, y1, greatest(x1 + 1, least(100, p2)) AS x2, greatest(y1 + 1, least(50, q2)) AS y2 FROM (
SELECT event_id AS id, greatest(0, least(99, (event_id % 131)::INT - 10)) AS x1, greatest(0, least(49, (event_id % 71)::INT - 10)) AS y1, (event_id % 149)::INT AS p2, (event_id % 83)::INT AS q2 FROM events)""")
def clamp_boxes(spark, sf_dir):
    m = lambda k, d=0: (F.col("event_id") % k).cast("int") - d
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.withColumns(B.clamp_box(m(131, 10), m(71, 10), m(149), m(83), F.lit(100), F.lit(50))).select(F.col("event_id").alias("id"), "x1", "y1", "x2", "y2")


@query(with_(BOXES, PIXBOX) + "SELECT id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY id))::BIGINT AS char_order, (row_number() OVER (PARTITION BY user_id ORDER BY y, x, id))::BIGINT AS position, format('char_{:04d}.png', row_number() OVER (PARTITION BY user_id ORDER BY id)) AS filename FROM d")
def reading_order(spark, sf_dir):
    found = _pixel_boxes(spark, sf_dir).withColumn("char_order", F.row_number().over(Window.partitionBy("user_id").orderBy("id")))
    return B.reading_order(found, "user_id").select("id", "user_id", F.col("char_order").cast("long"), F.col("position").cast("long"), X.char_file(F.col("char_order")).alias("filename"))


@query("SELECT event_id AS id, least(a, b)::INT AS x1, 5 AS y1, greatest(a, b)::INT AS x2, (5 + event_id % 3)::INT AS y2 FROM (SELECT event_id, event_id % 40 AS a, event_id % 17 AS b FROM events)")
def polygon_boxes(spark, sf_dir):
    """Boxes of polygons, which count where no flat list of numbers is given."""
    m = lambda k: (F.col("event_id") % k).cast("int")
    points = F.array(F.array(m(40), F.lit(5)), F.array(m(17), F.lit(5)), F.array(m(17), 5 + m(3)))
    box = B.flat_or_polygon_box(F.lit(None).cast("array<int>"), points)
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), box.alias("b"))
    return e.select("id", *(F.col("b")[k].alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))))


# ---- verdicts and counters --------------------------------------------------------------------------------------

VERDICT = """v AS (SELECT doc_id, doc_id % 5 <> 0 AS single, quality = 1 AS recognizable, toxic = 1 AS noisy,
  CASE doc_id % 4 WHEN 0 THEN '書' WHEN 1 THEN '書法' WHEN 2 THEN 'A' ELSE ' 山 ' END AS raw_char FROM labels),
k AS (SELECT *, trim(raw_char) AS character, single AND recognizable AND NOT noisy AND length(trim(raw_char)) = 1 AND unicode(trim(raw_char)) BETWEEN 19968 AND 40959 AS kept FROM v)"""


def _verdicts(spark, sf_dir):
    """Replies of a judge made of labels: fenced JSON, then parsed back."""
    char = F.element_at(F.array(*map(F.lit, ("書", "書法", "A", " 山 "))), (F.col("doc_id") % 4 + 1).cast("int"))
    reply = F.to_json(F.struct((F.col("doc_id") % 5 != 0).alias("single_character"), (F.col("quality") == 1).alias("recognizable"), (F.col("toxic") == 1).alias("has_noise"), char.alias("character")))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.select("doc_id", X.verdict(F.concat(F.lit("```json\n"), reply, F.lit("\n```"))).alias("v"))


@query(with_(VERDICT) + "SELECT doc_id, single AS single_character, recognizable, noisy AS has_noise, character, kept FROM k")
def keep_rule(spark, sf_dir):
    v = _verdicts(spark, sf_dir)
    return v.select("doc_id", "v.single_character", "v.recognizable", "v.has_noise", "v.character", X.keep(F.col("v")).alias("kept"))


@query(with_(VERDICT) + "SELECT doc_id % 7 AS folder, count(*) AS total_files, count(*) FILTER (WHERE kept) AS accepted, count(*) FILTER (WHERE NOT kept) AS filtered_out FROM k GROUP BY ROLLUP (doc_id % 7)")
def verdict_rollup(spark, sf_dir):
    """Counters of each folder and of the batch."""
    v = _verdicts(spark, sf_dir).select((F.col("doc_id") % 7).alias("folder"), X.keep(F.col("v")).alias("kept"))
    return v.rollup("folder").agg(F.count("*").alias("total_files"), F.count_if("kept").alias("accepted"), F.count_if(~F.col("kept")).alias("filtered_out"))


@query(with_(VERDICT) + "SELECT doc_id, CASE WHEN kept THEN format('{:03d}_{}.png', doc_id, character) ELSE format('reject_{:03d}.png', doc_id) END AS output_file FROM k")
def output_names(spark, sf_dir):
    v = _verdicts(spark, sf_dir)
    return v.select("doc_id", X.output_file(F.col("doc_id"), F.col("v.character"), X.keep(F.col("v"))).alias("output_file"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_docs(spark, sf_dir):
    docs, done = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return I.pending(docs.select("doc_id", "source"), done, ["doc_id"])


@query("SELECT source, count(*) AS total_files, count(l.doc_id) AS processed, count(*) - count(l.doc_id) AS pending FROM documents LEFT JOIN labels AS l USING (doc_id) GROUP BY source")
def batch_stats(spark, sf_dir):
    """Cached and pending rows, put together and counted."""
    docs, done = (spark.read.parquet(f"{sf_dir}/{t}.parquet").select(*c) for t, c in (("documents", ("doc_id", "source")), ("labels", ("doc_id",))))
    cached = docs.join(done, "doc_id", "left_semi").withColumn("done", F.lit(1))
    every = cached.unionByName(I.pending(docs, done, ["doc_id"]).withColumn("done", F.lit(0)))
    return every.groupBy("source").agg(F.count("*").alias("total_files"), F.sum("done").alias("processed"), F.sum(1 - F.col("done")).alias("pending"))


@query("""SELECT 'src' || (doc_id % 3) AS dataset, 'region_' || doc_id AS region, coalesce(a.text, b.text) AS expected FROM labels
LEFT JOIN (SELECT 'region_' || item_id AS key, text FROM benchmark WHERE item_id % 2 = 0) AS a ON a.key = 'region_' || doc_id
LEFT JOIN (SELECT 'src' || (item_id % 3) || ':region_' || item_id AS key, text FROM benchmark WHERE item_id % 2 = 1) AS b ON b.key = 'src' || (doc_id % 3) || ':region_' || doc_id""")
def expected_text_join(spark, sf_dir):
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    d, k = F.col("doc_id"), F.col("item_id")
    regions = labels.select(F.concat(F.lit("src"), (d % 3).cast("string")).alias("dataset"), F.concat(F.lit("region_"), d.cast("string")).alias("region"))
    name = F.concat(F.lit("region_"), k.cast("string"))
    key = F.when(k % 2 == 0, name).otherwise(F.concat(F.lit("src"), (k % 3).cast("string"), F.lit(":"), name))
    return B.expected_text(regions, bench.select(key.alias("key"), "text")).select("dataset", "region", "expected")


# ---- strings ----------------------------------------------------------------------------------------------------


@query(r"""SELECT page_id, CASE WHEN trim(url) = '' OR url IS NULL THEN 'unknown' ELSE substring(regexp_replace(trim(url), '[<>:"/\\|?*]', '_', 'g'), 1, 20) END AS name FROM pages""")
def safe_filename(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", X.safe_filename(F.col("url")).alias("name"))


@query(r"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE regexp_replace(text || chr(10) || '```', '^\s+', '') END AS text FROM conversations")
def strip_fence(spark, sf_dir):
    """Turns put into a code fence and taken out of it; odd ones have a closing fence only, which stays."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    closed = F.concat(F.col("text"), F.lit("\n```"))
    return c.select("conv_id", "turn", X.strip_fence(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```json\n"), closed)).otherwise(closed)).alias("text"))


@query("SELECT doc_id, len(regexp_extract_all(t, '[\\x{4E00}-\\x{9FFF}]'))::BIGINT AS n_cjk, length(t)::BIGINT AS n FROM (SELECT doc_id, coalesce(text, '') || '書' || (doc_id % 10) || '山鿿㐀' AS t FROM documents)")
def cjk_flag(spark, sf_dir):
    """Ideographs of whole texts, with some put behind each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("書"), (F.col("doc_id") % 10).cast("string"), F.lit("山鿿㐀"))
    chars = docs.select("doc_id", text.alias("t")).select("doc_id", "t", F.regexp_extract_all("t", F.lit("(?s)[^\\x00-\\x7F]"), F.lit(0)).alias("c"))
    return chars.select("doc_id", F.size(F.filter("c", X.is_cjk)).cast("long").alias("n_cjk"), F.length("t").cast("long").alias("n"))


PATHS = "p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/data/preocr/book' || page_id || '/a/img.' || page_id || '.JPG' WHEN 1 THEN 'x/y' || page_id || '.webp' ELSE '/in/preocr/b/preocr/c.tif' END AS path FROM pages)"


@query(with_(PATHS) + r"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'book' || page_id WHEN 1 THEN 'misc' ELSE 'b' END AS dataset, page_id % 3 <> 1 AS image, CASE page_id % 3 WHEN 1 THEN 'image/webp' ELSE 'image/jpeg' END AS mime,
CASE page_id % 3 WHEN 0 THEN 'img.' || page_id WHEN 1 THEN 'y' || page_id ELSE 'c' END AS stem, regexp_replace(path, '^(.*?)(\.[^./]*)$', '\1_preprocessed\2') AS output FROM p""")
def path_parts(spark, sf_dir):
    k, n = F.col("page_id") % 3, F.col("page_id").cast("string")
    path = F.when(k == 0, F.concat(F.lit("/data/preocr/book"), n, F.lit("/a/img."), n, F.lit(".JPG"))).when(k == 1, F.concat(F.lit("x/y"), n, F.lit(".webp"))).otherwise("/in/preocr/b/preocr/c.tif")
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", path.alias("path"))
    c = F.col("path")
    return p.select("page_id", I.dataset_key(c).alias("dataset"), I.is_image(c).alias("image"), I.mime_type(c).alias("mime"), X.stem(c).alias("stem"), X.preprocessed_name(c).alias("output"))


@query("SELECT page_id, to_base64(encode(url)) AS encoded FROM pages")
def base64_bytes(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", X.encode(F.col("url").cast("binary")).alias("encoded"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_props(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT event_type, quantile_cont(value, 0.5) AS median_value, max(value) AS max_value FROM events GROUP BY event_type")
def median_by_type(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    middle = T.median(e, "event_type", "value").withColumnRenamed("median", "median_value")
    return e.groupBy("event_type").agg(F.max("value").alias("max_value")).join(middle, "event_type", "left").select("event_type", "median_value", "max_value")


# ---- layers -----------------------------------------------------------------------------------------------------


@query("SELECT a, b, c, d, e FROM (SELECT unnest(range(1, 4))::INT AS a), (SELECT unnest(range(1, 7))::INT AS b), (SELECT unnest(range(1, 7))::INT AS c), (SELECT unnest(range(1, 4))::INT AS d), (SELECT unnest(range(1, 4))::INT AS e)")
def layer_combinations(spark, sf_dir):
    return L.combinations(spark)


@query("""SELECT layer, number, CASE layer WHEN 'B' THEN -60.0 WHEN 'C' THEN -90.0 ELSE 0.0 END::DOUBLE AS x, CASE layer WHEN 'A' THEN 60.0 WHEN 'B' THEN 260.0 WHEN 'C' THEN 480.0 WHEN 'D' THEN [650.0, 800.0, 700.0][number] ELSE 380.0 END::DOUBLE AS y
FROM (SELECT 'A' AS layer, unnest(range(1, 4))::INT AS number UNION ALL SELECT 'B', unnest(range(1, 7))::INT UNION ALL SELECT 'C', unnest(range(1, 7))::INT UNION ALL SELECT 'D', unnest(range(1, 4))::INT UNION ALL SELECT 'E', unnest(range(1, 4))::INT)""")
def layer_layout(spark, sf_dir):
    """Places of assets of 700 by 800."""
    return L.assets(spark).withColumns(L.place(F.col("layer"), F.col("number"), F.lit(700), F.lit(800))).select("layer", "number", "x", "y")


@query("""SELECT c_custkey AS id, z, layer, CASE layer WHEN 'A' THEN 1 + c_custkey % 3 WHEN 'B' THEN 1 + c_custkey % 6 WHEN 'C' THEN 1 + c_custkey % 5 WHEN 'D' THEN 1 + c_custkey % 2 ELSE 3 END::INT AS number, x_scale FROM customer,
(VALUES (0, 'B', 1), (1, 'C', 1), (2, 'B', -1), (3, 'C', -1), (4, 'A', 1), (5, 'D', 1), (6, 'E', 1)) AS t(z, layer, x_scale)""")
def layer_draws(spark, sf_dir):
    c = F.col("c_custkey")
    pick = lambda k: (1 + c % k).cast("int")
    chosen = spark.read.parquet(f"{sf_dir}/customer.parquet").select(c.alias("id"), pick(3).alias("a"), pick(6).alias("b"), pick(5).alias("c"), pick(2).alias("d"), F.lit(3).alias("e"))
    return L.draws(chosen, "id")


@query()
def layer_pick(spark, sf_dir):
    return L.tints(L.draws(L.pick(spark, 7)), 7).drop("rgb")


@query("SELECT c_custkey AS id, z, 3 AS n, true AS in_range, true AS has_full, 168.3::DOUBLE AS alpha FROM customer, (SELECT unnest(range(7))::INT AS z)")
def layer_tints(spark, sf_dir):
    """What every random tint keeps to: three shades from 50 to 255, one of them full, on one opacity."""
    c = F.col("c_custkey")
    chosen = spark.read.parquet(f"{sf_dir}/customer.parquet").select(c.alias("id"), *((1 + c % n).cast("int").alias(layer.lower()) for layer, n in L.COUNTS.items()))
    rgb = F.col("rgb")
    return L.tints(L.draws(chosen, "id"), 7).select("id", "z", F.size(rgb).alias("n"), ((F.array_min(rgb) >= 50) & (F.array_max(rgb) <= 255)).alias("in_range"), F.array_contains(rgb, 255).alias("has_full"), F.round("alpha", 6).alias("alpha"))


# ---- stages -----------------------------------------------------------------------------------------------------


@query("SELECT event_id AS id, CASE WHEN event_id % 5 >= 4 THEN 1 WHEN event_id % 7 > 0 THEN 2 ELSE 0 END AS rule, CASE WHEN event_id % 5 >= 4 THEN (event_id % 40)::INT WHEN event_id % 7 > 0 THEN 3 ELSE -1 END AS x1 FROM events")
def box_arity(spark, sf_dir):
    """Flat lists of four numbers count, shorter ones do not, then polygons, and without either there is no box."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    n = lambda k: (F.col("event_id") % k).cast("int")
    flat = F.slice(F.array(n(40), F.lit(1), F.lit(50), F.lit(9)), F.lit(1), n(5))
    points = F.when(n(7) > 0, F.array(F.array(F.lit(3), F.lit(4)), F.array(F.lit(8), F.lit(9))))
    box = B.flat_or_polygon_box(flat, points)
    return e.select(F.col("event_id").alias("id"), F.when(F.size(flat) >= 4, 1).when(box.isNotNull(), 2).otherwise(0).alias("rule"), F.coalesce(box[0], F.lit(-1)).alias("x1"))


@query("SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 30 ELSE -1 END AS x1 FROM events")
def first_box_key(spark, sf_dir):
    """The first of bbox, rect and box that a record has."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    k = F.col("event_id") % 4
    of = lambda at, x: F.when(k <= at, F.array(F.lit(x), F.lit(1), F.lit(2), F.lit(3)))
    record = F.struct(of(0, 10).alias("bbox"), of(1, 20).alias("rect"), of(2, 30).alias("box"))
    return e.select(F.col("event_id").alias("id"), F.coalesce(B.first_box(record)[0], F.lit(-1)).alias("x1"))


FILES = "f AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/d/preocr/b' || (page_id % 3) || '/region_' || page_id || '.png' WHEN 1 THEN '/d/b' || (page_id % 5) || '/char_' || page_id || '.jpg' WHEN 2 THEN '/d/b/debug/char_' || page_id || '.png' ELSE '/d/region_' || page_id || '.txt' END AS path FROM pages)"


def _files(spark, sf_dir):
    k, n = F.col("page_id") % 4, F.col("page_id").cast("string")
    path = F.when(k == 0, F.concat(F.lit("/d/preocr/b"), (F.col("page_id") % 3).cast("string"), F.lit("/region_"), n, F.lit(".png"))).when(k == 1, F.concat(F.lit("/d/b"), (F.col("page_id") % 5).cast("string"), F.lit("/char_"), n, F.lit(".jpg")))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(path.when(k == 2, F.concat(F.lit("/d/b/debug/char_"), n, F.lit(".png"))).otherwise(F.concat(F.lit("/d/region_"), n, F.lit(".txt"))).alias("path"))


@query(with_(FILES) + "SELECT path, 'b' || (page_id % 3) AS dataset, 'region_' || page_id || '.png' AS region FROM f WHERE page_id % 4 = 0")
def region_files(spark, sf_dir):
    """Region files among other files, by dataset."""
    return I.region_images(_files(spark, sf_dir))


@query(with_(FILES) + "SELECT DISTINCT '/d/b' || (page_id % 5) AS folder FROM f WHERE page_id % 4 = 1")
def character_folders(spark, sf_dir):
    return I.char_folders(_files(spark, sf_dir))


@query(r"""SELECT page_id, CASE WHEN trim(url) = '' OR url IS NULL THEN 'unknown' ELSE substring(regexp_replace(trim(url), '[<>:"/\\|?*]', '_', 'g'), 1, 20) END AS name FROM pages""")
def sql_functions(spark, sf_dir):
    """The SQL surface: a registered function in a statement."""
    register(spark)
    return spark.sql("SELECT page_id, safe_filename(url) AS name FROM {pages}", pages=spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: A recorded page: one good box, one beyond the edge, one of three numbers that goes.
REPLY = '{"success": true, "text_regions": [{"bbox": [1, 2, 20, 9], "text": "a", "confidence": 0.5}, {"rect": [5, 6, 900, 900], "text": "b"}, {"box": [1, 2, 3]}]}'


@query("""SELECT image_id, region_id, x1, y1, x2, y2, text, confidence FROM (SELECT DISTINCT (vec_id // 3)::VARCHAR AS image_id FROM embeddings WHERE vec_id // 3 <= (SELECT max(vec_id) // 3 - CASE WHEN max(vec_id) % 3 = 2 THEN 0 ELSE 1 END FROM embeddings)) AS i,
(VALUES (1, 1, 2, 20, 9, 'a', 0.5::DOUBLE, false), (2, 5, 6, 32, 32, 'b', 0.0::DOUBLE, false), (1, 0, 0, 32, 32, '', 0.0::DOUBLE, true)) AS r(region_id, x1, y1, x2, y2, text, confidence, failed) WHERE failed = (image_id::BIGINT % 2 = 1)""")
def detected_regions(spark, sf_dir):
    """Regions of recorded replies: boxes clamped, short ones dropped, a failed page as one region."""

    found = stages.detect(_pages(spark, sf_dir), _recorded)
    return found.select("image_id", "region_id", "x1", "y1", "x2", "y2", "text", "confidence")


def _recorded(key: str, png: bytes) -> str:
    """The recorded page for even images; the detector fails on others."""
    if int(key) % 2:
        raise KeyError(key)
    return REPLY


def _pages(spark, sf_dir):
    """Colour rasters four times their size: small page images."""
    return map_raster(R.colour_rasters(spark, sf_dir), lambda x: np.kron(x, np.ones((4, 4, 1), np.uint8)))


def _detected(regions: DataFrame) -> DataFrame:
    """Two recorded characters in each region."""
    found = F.array(*(F.struct(F.lit(k).alias("det_idx"), F.lit(t).alias("text"), F.lit(0.9).alias("confidence"), F.array(*map(F.lit, box)).alias("nbox")) for k, (t, box) in enumerate((("山", (0.5, 0.0, 0.5, 1.0)), ("書", (0.0, 0.0, 0.5, 1.0))))))
    return regions.select("image_id", F.lit(1).alias("region_id"), F.explode(found).alias("d")).select("image_id", "region_id", "d.*")


def _always(key: str, png: bytes) -> str:
    """A recorded judge: characters of even files are fine."""
    good = "true" if key.endswith("2.png") else "false"
    return f'{{"single_character": true, "recognizable": {good}, "has_noise": false, "character": "山", "comment": ""}}'


#: Pages whose three vectors are all there.
WHOLE = "i AS (SELECT vec_id // 3 AS k FROM embeddings GROUP BY ALL HAVING count(DISTINCT vec_id) = 3)"


@query(with_(WHOLE, "r AS (SELECT k || ':' || region AS image_id FROM i, (VALUES (1), (2)) AS t(region) WHERE region = 1 OR k % 2 = 0)") + """SELECT image_id, CASE WHEN image_id IS NOT NULL THEN 1 END::INT AS region_id, 2 * count(*) AS total_files, count(*) AS accepted, count(*) AS filtered_out, 0::BIGINT AS error
FROM r GROUP BY ROLLUP (image_id)""")
def pipeline_report(spark, sf_dir):
    """All four stages with recorded models: pages, their regions, two characters in each, and what the judge keeps."""
    folder = _folder(spark)

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    done = stages.run_pipeline(_pages(spark, sf_dir), Settings(), stages.STAGES, _recorded, _detected, _always, write)
    return done["report"]


@query(with_(WHOLE) + "SELECT k::VARCHAR AS image_id, 1 AS region_id, 2::BIGINT AS character_count, CASE WHEN k % 2 = 0 THEN 3 END::INT AS expected_text_len FROM i")
def segment_summaries(spark, sf_dir):
    """Characters of each region beside the length of the text that was expected there; every other one has none."""
    pages = _pages(spark, sf_dir)
    expected = pages.select("image_id", F.lit("山 書").alias("expected")).where(F.col("image_id").cast("long") % 2 == 0)
    return stages.segment_summary(stages.segment(pages, _detected(pages), Settings()), expected).drop("characters")


@query(with_(WHOLE) + "SELECT k::VARCHAR AS image_id, k % 5 = 0 AS failed FROM i")
def failed_rasters(spark, sf_dir):
    """Rasters with missing bytes are error rows; the others go through the stage."""
    cut = F.when(F.col("image_id").cast("long") % 5 == 0, F.expr("substring(data, 1, 7)")).otherwise(F.col("data"))
    good, bad = stages.preprocess_errors(_pages(spark, sf_dir).withColumn("data", cut), Settings())
    return good.select("image_id", F.lit(False).alias("failed")).unionByName(bad.select("image_id", F.col("error").isNotNull().alias("failed")))


# ---- files ------------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors reach; a temporary one only where driver and executors are one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not shared and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = (shared or tempfile.mkdtemp(prefix="sumi-")).rstrip("/")
    return f"{root}/sumi-files-{uuid.uuid4().hex}"


def _written(spark, sf_dir) -> str:
    """The gray rasters as PNG files r<id>.png, among them one that is no image."""
    folder = _folder(spark)
    named = S.with_png(_rasters(spark, sf_dir)).select(F.concat(F.lit("r"), "image_id", F.lit(".png")).alias("output_file"), "png")
    note = spark.range(1).select(F.lit("notes.txt").alias("output_file"), F.lit("none").cast("binary").alias("png"))
    S.write_files(named.unionByName(note), folder).write.format("noop").mode("overwrite").save()
    return folder


@query("SELECT 'r' || vec_id || '.png' AS name, true AS has_bytes FROM embeddings")
def listed_images(spark, sf_dir):
    """The image files of a folder."""
    found = I.list_images(spark, _written(spark, sf_dir))
    return found.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), (F.col("length") > 0).alias("has_bytes"))


@query(with_(PX) + "SELECT image_id, y, x, v FROM px")
def decoded_images(spark, sf_dir):
    """Rasters written as PNG files, listed, read and decoded again."""
    found = I.read_images(spark, _written(spark, sf_dir))
    return pixel_rows(found.withColumn("image_id", F.regexp_extract("image_id", r"r(\d+)\.png$", 1)), K.gray)


@query("SELECT page_id || '.txt' AS file, octet_length(encode(coalesce(html, '')))::BIGINT AS bytes FROM pages")
def written_files(spark, sf_dir):
    """Pages written as files under their names: the names and lengths that are found there afterwards."""
    folder = _folder(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    named = pages.select(F.concat(F.col("page_id").cast("string"), F.lit(".txt")).alias("output_file"), F.coalesce("html", F.lit("")).cast("binary").alias("png"))
    S.write_files(named, folder).write.format("noop").mode("overwrite").save()
    found = spark.read.format("binaryFile").load(folder).select("path", "length")
    return found.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"))


@query(with_(BOXES, PIXBOX) + "SELECT id, x, y, w, h FROM d")
def json_records(spark, sf_dir):
    """Boxes written as JSON records and read again."""
    folder = _folder(spark)
    S.write_json(_pixel_boxes(spark, sf_dir).select("id", F.struct("x", "y", "w", "h").alias("bbox")), folder)
    return spark.read.schema("id long, bbox struct<x:int,y:int,w:int,h:int>").json(folder).select("id", "bbox.*")


def _jet_sql(k: int) -> str:
    return f"round_even(greatest(0, least(1, least(j - {k} + 1.5::DOUBLE, {k} + 1.5::DOUBLE - j))) * 255, 0)::INT"


@query(with_(ST, _heal_sql("px", "healed"), "gap AS (SELECT a.image_id, a.y, a.x, abs(a.v - b.v) AS u FROM healed AS a JOIN px AS b USING (image_id, y, x))", _stretch_sql("gap", "u", "far"), "c AS (SELECT image_id, y, x, v / 255.0::DOUBLE * 4 AS j FROM far_v)")
       + f"SELECT image_id::VARCHAR AS image_id, string_agg(printf('%02X%02X%02X', {_jet_sql(1)}, {_jet_sql(2)}, {_jet_sql(3)}), '' ORDER BY y, x) AS bgr FROM c GROUP BY image_id")
def jet_colours(spark, sf_dir):
    """Stretched differences of each raster and its healed form, as colours."""
    return map_raster(_stretched_rasters(spark, sf_dir), lambda x: K.jet(K.minmax(np.abs(K.heal(x).astype(int) - x)))).select("image_id", F.hex("data").alias("bgr"))


@query(with_(PX, """g AS (SELECT image_id, y, x, greatest(0, least(7, (y + 0.5::DOUBLE) * 8 / 12 - 0.5::DOUBLE)) AS fy, greatest(0, least(7, (x + 0.5::DOUBLE) * 8 / 5 - 0.5::DOUBLE)) AS fx
  FROM (SELECT DISTINCT image_id FROM px), (SELECT unnest(range(12))::INT AS y), (SELECT unnest(range(5))::INT AS x)),
c AS (SELECT *, floor(fy)::INT AS y0, floor(fx)::INT AS x0, least(floor(fy)::INT + 1, 7) AS y1, least(floor(fx)::INT + 1, 7) AS x1 FROM g)""") + """SELECT c.image_id, c.y, c.x, greatest(0, least(255, round_even((a.v * (1 - (fx - x0)) + b.v * (fx - x0)) * (1 - (fy - y0)) + (d.v * (1 - (fx - x0)) + e.v * (fx - x0)) * (fy - y0), 0)))::INT AS v
FROM c JOIN px AS a ON a.image_id = c.image_id AND a.y = y0 AND a.x = x0 JOIN px AS b ON b.image_id = c.image_id AND b.y = y0 AND b.x = x1
JOIN px AS d ON d.image_id = c.image_id AND d.y = y1 AND d.x = x0 JOIN px AS e ON e.image_id = c.image_id AND e.y = y1 AND e.x = x1""")
def resized(spark, sf_dir):
    return pixel_rows(_rasters(spark, sf_dir), lambda x: K.resize(x, 12, 5))


@query()
def png_files(spark, sf_dir):
    return S.with_png(_rasters(spark, sf_dir)).select("image_id", F.length("png").alias("bytes"), F.md5("png").alias("md5"))


@query()
def contour_overlays(spark, sf_dir):
    return jobs.overlays(R.colour_rasters(spark, sf_dir), SMALL).select("image_id", F.md5("data").alias("md5"))


@query()
def heal_changes(spark, sf_dir):
    return stages.heal_debug(_pages(spark, sf_dir), Settings())


@query()
def segment_debug(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return stages.segment_debug(pages, _detected(pages), Settings())


@query()
def preprocess_stage(spark, sf_dir):
    return stages.preprocess(_pages(spark, sf_dir), Settings()).select("image_id", "height", "width", F.sha2("data", 256).alias("data_sha256"))


@query()
def segment_stage(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return stages.segment(pages, _detected(pages), Settings()).select("image_id", "char_order", "filename", "x", "y", "w", "h", "text")


@query()
def segment_overlays(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return stages.segment_overlay(pages, stages.segment(pages, _detected(pages), Settings())).select("image_id", "height", "width", F.md5("data").alias("md5"))


@query("""SELECT image_id, CASE WHEN image_id IS NOT NULL THEN 1 END::INT AS region_id, 2 * count(*) AS total_files, count(*) AS accepted, count(*) AS filtered_out, 0::BIGINT AS error
FROM (SELECT (vec_id // 3)::VARCHAR AS image_id FROM embeddings GROUP BY ALL HAVING count(DISTINCT vec_id) = 3) GROUP BY ROLLUP (image_id)""")
def judge_report(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    chars = stages.segment(pages, _detected(pages), Settings())
    return stages.report(stages.judge(chars, _always, Settings()))
