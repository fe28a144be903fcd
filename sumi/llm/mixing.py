"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words: a share of all words by weight, stopped at `cap` times what the source has,
the excess reshared by weight among the others. Sorted by the ratio of stop to weight the stopped sources are a
prefix, so one running sum over the sources (not the documents) finds all targets.

The whole part of target / source words is taken as certain copies of every document. The rest is a sample of fixed
size with unequal probabilities: a document's inclusion probability p is min(1, c * size ** tilt), c solved for each
source so that the words expected of the sample are the words that are left to take; longer documents are likelier and
tilt = 0 makes a source's documents alike. Documents are ranked by their random odds u/(1-u) divided by their inclusion
odds p/(1-p), certain ones first, and taken in that order as long as the words allow; one more, the one that comes
nearest, closes the gap. u comes from a hash of id, source, text and, of rows that are alike in these, their number, so
reruns agree, however the rows lie, and rows that share an id or have none are sampled each on their own.

No task holds a source: c comes from the sizes' histogram, the ranking is cut into bins, bin sums locate the cut, and
only the rows of the one bin in which the cut falls are sorted. What is decided is one row for each source: the last
row taken, and the one that closes the gap. `mix` applies these to the documents themselves, row by row.

Edge cases: null texts have size 0 and are not taken; a null source is a source of its own, last; an empty table gives
no rows; columns with clashing names are kept (names that begin with two underscores are not allowed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import join_checked, materialize, row_key, times

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
TILT = 0.5
BINS = 4096
SEED = "mix"


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _key(source: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def _content(seed: str) -> Column:
    """A digest of id, source and text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}|"), text("doc_id"), F.lit("|"), text("source"), F.lit("|"), F.md5(text("text").cast("binary"))).cast("binary"))


def _random(content: Column, number: Column) -> Column:
    """Between 0 and 1, from the digest and the row's number among rows that are alike."""
    digest = F.md5(F.concat(content, F.lit("|"), number.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """key, source_size, target of each source. Windows here run over one row for each source."""
    each = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    each = each.withColumn("weight", weight.cast("double")).withColumn("stop", F.lit(float(cap)) * F.col("source_size"))
    by_stop = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    each = each.withColumns(
        {
            "total": F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)),
            "stopped_before": F.coalesce(F.sum("stop").over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "weight_from": F.sum("weight").over(by_stop.rowsBetween(0, Window.unboundedFollowing)),
        }
    ).withColumn("stopped", F.col("stop") * F.col("weight_from") <= F.col("weight") * (F.col("total") - F.col("stopped_before")))
    everywhere = Window.partitionBy()
    stopped = F.coalesce(F.sum(F.when(F.col("stopped"), F.col("stop"))).over(everywhere), F.lit(0.0))
    free = F.sum(F.when(~F.col("stopped"), F.col("weight"))).over(everywhere)
    level = F.try_divide(F.col("total") - stopped, free)
    return each.withColumn("target", F.when(F.col("stopped"), F.col("stop")).otherwise(F.col("weight") * level)).select("key", "source_size", "target")


def inclusion(sized: DataFrame, sources: DataFrame, tilt: float = TILT) -> DataFrame:
    """key and c of each source: p = min(1, c * size ** tilt), so that the expected words are what is left to take.

    From the largest size on, sizes are certain as long as c of what remains would exceed 1 there; a window holds the
    different sizes of one source, not its documents. c is null where all documents are certain."""
    sizes = join_checked(sized.where("size > 0").groupBy("key", "size").agg(F.count("*").alias("n")), sources.select("key", "rest"), "key")
    down = Window.partitionBy("key").orderBy(F.col("size").desc())
    larger = F.coalesce(F.sum(F.col("size") * F.col("n")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight = F.pow(F.col("size").cast("double"), F.lit(float(tilt)))
    others = F.sum(F.col("n") * F.col("size") * weight).over(down.rowsBetween(0, Window.unboundedFollowing))
    solved = sizes.withColumn("c", (F.col("rest") - larger) / others)
    return solved.where(F.col("c") * weight < 1).groupBy("key").agg(F.max_by("c", "size").alias("c"))


def _numbered(sized: DataFrame) -> DataFrame:
    """`number`: 1, 2, ... among the rows of one content. Rows are counted where they lie and what lies before is
    added, so many equal rows do not meet in one task."""
    sized = sized.withColumn("part", F.shiftright("row", 33))
    counts = sized.groupBy("content", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("content").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = materialize(counts.withColumn("before", before).where("before > 0").select("content", "part", "before"), "numbers-before", narrow=True)
    here = sized.withColumn("here", F.row_number().over(Window.partitionBy("content", "part").orderBy("row")))
    return join_checked(here, before, ["content", "part"]).withColumn("number", F.col("here") + F.coalesce("before", F.lit(0))).drop("part", "here", "before")


def _order(get, tilt: float) -> Column:
    """The rank: null where nothing is to be drawn, 0 where inclusion is certain. `get` gives a column by its name."""
    p = F.least(F.lit(1.0), F.coalesce(get("c") * F.pow(get("size").cast("double"), F.lit(float(tilt))), F.lit(1.0)))
    u = _random(get("content"), get("number"))
    return F.when(get("size") > 0, F.when(p >= 1, F.lit(0.0)).when(p > 0, u / (1 - u) / (p / (1 - p))))


def _bin(order: Column, bins: int) -> Column:
    return F.floor(order / (1 + order) * bins)


#: The order of a source's documents: by rank, and ties by what does not depend on how rows lie.
PLACE = ("order", "size", "content", "number")


def _sampled(sized: DataFrame, sources: DataFrame, tilt: float, bins: int) -> tuple[DataFrame, DataFrame]:
    """The ranked rows, and one row for each source with `last` (place of the last row that the words allow) and
    `filler` (place of the row that closes the gap); null where there is none."""
    ranked = join_checked(sized, sources, "key").withColumn("order", _order(F.col, tilt)).withColumn("bin", _bin(F.col("order"), bins))
    ranked = materialize(ranked, "ranked-sizes")
    live = ranked.where(F.col("order").isNotNull())
    place = F.struct(*PLACE)
    bin_sums = live.groupBy("key", "bin").agg(F.sum("size").alias("n"), F.max("rest").alias("rest"))
    so_far = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = bin_sums.withColumn("before", so_far).where(F.col("before") < F.col("rest")).groupBy("key").agg(F.max("bin").alias("cut"), F.max("before").alias("before"))
    at_cut = join_checked(live, cuts, "key", "inner").where(F.col("bin") == F.col("cut"))
    to = F.col("before") + F.sum("size").over(Window.partitionBy("key").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, 0))
    fits = at_cut.withColumn("to", to).where(F.col("to") <= F.col("rest")).groupBy("key").agg(F.max(place).alias("last_at_cut"), F.max("to").alias("to"))
    ends = cuts.join(fits, "key", "left").select("key", "cut", "last_at_cut", F.coalesce("to", "before").alias("words"))
    ends = materialize(ends, "cuts", narrow=True)
    left = join_checked(live, ends, "key", "inner").withColumn("gap", F.col("rest") - F.col("words")).where(~_sampled_row(F.col, place))
    off = F.abs(F.col("size") - F.col("gap"))
    fillers = left.where(off < F.col("gap")).groupBy("key").agg(F.min_by(place, F.struct(off, *PLACE)).alias("filler"))
    return ranked, ends.join(fillers, "key", "left").select("key", "cut", "last_at_cut", "filler")


def _sampled_row(get, place: Column) -> Column:
    """Whether the row stands before the cut of its source."""
    last = F.coalesce(place <= get("last_at_cut"), F.lit(False))
    return F.coalesce((get("bin") < get("cut")) | (get("bin") == get("cut")) & last, F.lit(False))


def _copies(get, place: Column) -> Column:
    """How often the mix takes a row, which stands beside what is decided for its source."""
    more = _sampled_row(get, place) | F.coalesce(place == get("filler"), F.lit(False))
    return F.when(get("size") > 0, get("whole") + more.cast("long")).otherwise(0).cast("long")


def _decided(docs: DataFrame, weights, share, cap, tilt, bins, seed, keep: tuple[Column, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """All rows (narrow) with `copies`, and the sources with what is decided for each."""
    sized = docs.select("doc_id", "source", F.monotonically_increasing_id().alias("row"), _key().alias("key"), words(F.col("text")).alias("size"), _content(seed).alias("content"), *keep)
    sized = materialize(_numbered(materialize(sized, "sizes")), "numbered")
    sources = targets(sized, weights, share, cap).withColumn("whole", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
    sources = sources.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = materialize(sources, "targets", narrow=True)
    sources = materialize(sources.join(inclusion(sized, sources, tilt), "key", "left"), "sources", narrow=True)
    ranked, ends = _sampled(sized, sources, tilt, bins)
    ends = materialize(ends, "mix-ends", narrow=True)
    return join_checked(ranked, ends, "key").withColumn("copies", _copies(F.col, F.struct(*PLACE))), materialize(sources.join(ends, "key", "left"), "mix-sources", narrow=True)


def plan_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, tilt: float = TILT, bins: int = BINS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    rows, _ = _decided(docs, weights, share, cap, tilt, bins, seed)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, tilt: float = TILT, bins: int = BINS, seed: str = SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken.

    A row finds its copies from its own columns and its source's row; only rows that are alike in id, source and text
    are numbered, so these go by the plan, through `base.times`. Texts are not moved for it."""
    rows, sources = _decided(docs, weights, share, cap, tilt, bins, seed, (row_key(docs).alias("row_key"),))
    alike = rows.groupBy("content").agg(F.max("number").alias("n")).where("n > 1").select("content")
    planned = join_checked(rows.select("content", "row_key", "copies"), materialize(alike, "alike", narrow=True), "content", "inner")
    mine = {"size": words(F.col("text")), "content": _content(seed), "number": F.lit(1).cast("long")}
    each = docs.withColumns({"__key": _key(), "__row": F.struct(*(v.alias(k) for k, v in mine.items()))})
    table = sources.select(F.col("key").alias("__key"), F.struct("c", "whole", "cut", "last_at_cut", "filler").alias("__source"))
    each = join_checked(each, table, "__key")
    get = lambda name: F.col(f"__{name}") if name in ("order", "bin") else F.col("__row" if name in mine else "__source")[name]
    each = each.withColumn("__order", _order(get, tilt)).withColumn("__bin", _bin(F.col("__order"), bins))
    return times(each, planned, _copies(get, F.struct(*(get(c).alias(c) for c in PLACE))))


SQL = r"""
WITH d0 AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(source, '') || '|' || md5(coalesce(text, ''))) AS content
  FROM documents),
d1 AS (SELECT *, row_number() OVER (PARTITION BY content) AS number FROM d0),
d AS (SELECT *, (('0x' || substr(md5(content || '|' || number), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM d1),
s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CAST([5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS DOUBLE) AS weight
  FROM d GROUP BY source),
s1 AS (
  SELECT *, 2.0::DOUBLE * source_size AS stop, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM s0),
s2 AS (
  SELECT *, coalesce(sum(stop) OVER (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped_before,
         sum(weight) OVER (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from
  FROM s1),
s3 AS (SELECT *, stop * weight_from <= weight * (total - stopped_before) AS stopped FROM s2),
s4 AS (
  SELECT *, CASE WHEN stopped THEN stop ELSE weight * ((total - coalesce(sum(stop) FILTER (WHERE stopped) OVER (), 0)) / sum(weight) FILTER (WHERE NOT stopped) OVER ()) END AS target
  FROM s3),
s5 AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS whole FROM s4),
s6 AS (SELECT *, target - whole * source_size AS rest FROM s5),
h0 AS (SELECT s6.source, size, any_value(rest) AS rest, count(*) AS n FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source WHERE size > 0 GROUP BY s6.source, size),
h1 AS (
  SELECT *, (rest - coalesce(sum(size * n) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(n * size * pow(size::DOUBLE, 0.5::DOUBLE)) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c FROM h0),
h AS (SELECT source, arg_max(c, size) AS c FROM h1 WHERE c * pow(size::DOUBLE, 0.5::DOUBLE) < 1 GROUP BY source),
s AS (SELECT s6.*, h.c FROM s6 LEFT JOIN h ON h.source IS NOT DISTINCT FROM s6.source),
r0 AS (
  SELECT d.*, s.source_size, s.target, s.whole, s.rest, least(1.0::DOUBLE, coalesce(s.c * pow(d.size::DOUBLE, 0.5::DOUBLE), 1.0::DOUBLE)) AS p
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
r AS (SELECT *, CASE WHEN size > 0 THEN CASE WHEN p >= 1 THEN 0.0::DOUBLE WHEN p > 0 THEN u / (1 - u) / (p / (1 - p)) END END AS ord FROM r0),
c AS (
  SELECT *, row_number() OVER (ORDER BY ord, size, content, number) AS k,
         coalesce(ord IS NOT NULL AND sum(size) OVER (PARTITION BY source ORDER BY ord NULLS LAST, size, content, number ROWS UNBOUNDED PRECEDING) <= rest, false) AS extra
  FROM r),
g AS (SELECT source, any_value(rest) - coalesce(sum(size) FILTER (WHERE extra), 0) AS gap FROM c GROUP BY source),
f AS (
  SELECT c.k FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source WHERE NOT extra AND ord IS NOT NULL AND abs(size - gap) < gap
  QUALIFY row_number() OVER (PARTITION BY c.source ORDER BY abs(size - gap), ord, size, content, number) = 1)
SELECT doc_id, size, source_size, target,
       CASE WHEN size > 0 THEN whole * size + CASE WHEN extra OR k IN (SELECT k FROM f) THEN size ELSE 0 END ELSE 0 END::BIGINT AS taken
FROM c
"""
