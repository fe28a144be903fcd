"""What the operators of this subpackage share: reading, writing between steps, joins of checked size."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which `join_checked` broadcasts a side of a few narrow columns (about 50 MB at most).
BROADCAST_ROWS = 1_000_000

#: Rows and bytes of whole texts in an Arrow batch; each worker holds a batch or two in both of its processes. The JVM
#: copies a batch to buffers beside its heap that double as they grow, and what it frees there stays with the process.
TEXT_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 1 << 20}

#: Bits of a key filter (16 MB), whatever the number of keys; each key sets four of them.
FILTER_BITS = 27

_own_folder: list[str] = []

#: What this Python worker keeps from task to task.
_kept: dict[str, object] = {}


def scratch(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one only where that is unset and all run in one JVM."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="sumi-"))
    return _own_folder[0]


@contextmanager
def text_batches(spark: SparkSession):
    """Arrow batches of whole texts are bounded by rows and by bytes while this is open; then the session is as before."""
    before = {k: spark.conf.get(k) for k in TEXT_BATCH}
    for k, most in TEXT_BATCH.items():
        if not 0 < int(before[k].rstrip("b")) <= most:
            spark.conf.set(k, str(most))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def keep(name: str, make):
    """What `make` gives, made once in each Python worker: it stays until a `tidy` task of another name begins there."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def drop_kept(name: str | None = None) -> None:
    """Drop what this worker keeps under other names; memory without use goes back to the system."""
    for other in _kept.keys() - {name}:
        del _kept[other]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def tidy(run, name: str | None = None):
    """`run` for mapInArrow in workers that serve one operator after the other: what others keep there is dropped first,
    and what the task itself no longer needs goes back to the system at its end."""

    def task(batches):
        drop_kept(name)
        try:
            yield from run(batches)
        finally:
            drop_kept(name)

    return task


def materialize(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there and lost executors lose nothing.

    Tables of a few numbers a row (`narrow`) are written as two files for each core of the cluster at most: on some
    file systems a file costs an executor more than the rows in it."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    with text_batches(spark):
        (df.coalesce(2 * spark.sparkContext.defaultParallelism) if narrow else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sumi_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete what `materialize` wrote for these; only for tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_sumi_path", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def join_checked(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "left", limit: int | None = None) -> DataFrame:
    """Join; `right` is broadcast only after counting that it has at most `limit` rows, else both are shuffled.

    The hint keeps Spark from judging a side by its compressed files and broadcasting it all the same."""
    limit = BROADCAST_ROWS if limit is None else limit
    few = right.limit(limit + 1).count() <= limit
    return left.join(F.broadcast(right) if few else right.hint("merge"), on, how)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id="doc_id"):
    """Rows whose crc32(doc_id as text) mod 3 is 1; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_labels(labels: DataFrame, column: str, most: int) -> DataFrame:
    """doc_id and __y of the labelled ids that may be learnt from, one row for each; the larger of repeated labels.

    Beyond `most` ids a sample by hash: 95 % of `most` in expectation, so `most` stays a bound and the result may be
    broadcast at any size."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("__y"))
    known = materialize(known.where(~held_out()), f"{column}-labels")
    n = known.count()
    if n <= most:
        return known
    return materialize(known.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(10**9)) < int(0.95 * most / n * 10**9)), f"{column}-sample")


def row_key(docs: DataFrame) -> Column:
    """128 bits of hash over all columns but maps: rows with one key are the same row, repeated."""
    columns = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))


def key_filter(keys: DataFrame, bits: int | None = None):
    """A function that tells of a `row_key` column whether it may be among the `row_key`s of `keys`: a Bloom filter.

    It never misses a key and its size is fixed, so it can be sent to all executors at any size of `keys`; the fuller
    it is, the more other keys it lets through too, which costs time only."""
    bits = bits or FILTER_BITS
    mask = (1 << bits) - 1
    spots = F.explode(F.array(*(F.shiftrightunsigned(f"row_key.{part}", shift).bitwiseAND(mask) for part in "ab" for shift in (0, bits)))).alias("at")
    with_bit = keys.select(spots).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    found = with_bit.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2 ** (FILTER_BITS - 6) rows at most
    words = np.zeros((mask >> 6) + 1, np.uint64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    shared = keys.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def maybe(a: pd.Series, b: pd.Series) -> pd.Series:
        table, out = shared.value, np.ones(len(a), bool)
        for part in (a, b):
            x = part.to_numpy(np.int64).view(np.uint64)
            for shift in (0, bits):
                at = (x >> np.uint64(shift)) & np.uint64(mask)
                out &= (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return pd.Series(out)

    return lambda key: maybe(key["a"], key["b"])


def times(docs: DataFrame, plan: DataFrame, copies: Column | None = None) -> DataFrame:
    """The rows of `docs`: those whose key is in `plan` (row_key, copies) as often as it says in all, others `copies` times.

    What the key filter rules out goes straight through. The rest, which grows with the plan and not with `docs` while
    the filter is not full, meets the plan by its key, repeated rows as one, so no key is hot. `copies` may use
    columns of `docs` whose names begin with two underscores; they do not count as part of a row and are dropped."""
    names = [c for c in docs.columns if not c.startswith("__")]
    plan = materialize(plan.groupBy("row_key").agg(F.sum("copies").cast("long").alias("__planned")), "copies")
    keyed = docs.withColumns({"__row_key": row_key(docs.select(*names)), "__copies": (F.lit(1) if copies is None else copies).cast("long")})
    maybe = key_filter(plan)(F.col("__row_key"))
    straight = keyed.where(~maybe).select(*names, "__copies")
    met = keyed.where(maybe).groupBy("__row_key").agg(F.first(F.struct(*names)).alias("__row"), F.sum("__copies").alias("__copies"))
    met = met.join(plan.withColumnRenamed("row_key", "__row_key"), "__row_key", "left")
    met = met.select(*(F.col("__row")[n].alias(n) for n in names), F.coalesce("__planned", "__copies").alias("__copies"))
    every = straight.unionByName(met).where("__copies > 0")
    return every.withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*names)
