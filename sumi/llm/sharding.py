"""Sharding by extendible hashing, in DataFrame functions only.

A document's key hash is a string of bits; the directory holds one bucket for each prefix in use. A bucket splits
on its next bit only while its bytes exceed the limit and it has more than one document. Bits are taken twelve at
a time: one aggregation gives the bytes of all prefixes of up to twelve bits inside the buckets that are still too
large, every cell takes the shortest prefix that fits, and only the cells that no prefix fits go on to the next
twelve. 120 bits are there: 60 of the key (so a key's shard is stable) and 60 of the row, which part rows that share
a key, so a key that holds a third of all rows is split too.

The first directory has 4,096 cells; later ones grow as bytes over limit and are joined by a shuffle when large.
Only counts are shuffled (a row for each cell and task) until the result is joined.

Edge cases: null and empty texts have 0 bytes; a null id is a key of its own; one document above the limit is a
shard alone, marked `oversized`; an empty table gives no rows; repeated rows are parted by row bits as needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import join_checked, materialize

LIMIT_BYTES = 64 << 20
STEP = 12
ROUNDS = 10
#: Rows up to which a directory is broadcast: each holds a path besides its numbers, some 200 bytes in a hash table.
DIRECTORY_ROWS = 100_000


def shards(docs: DataFrame, limit_bytes: int = LIMIT_BYTES, keep: tuple[str, ...] = ("doc_id",), row: Column | None = None) -> DataFrame:
    """The columns `keep`, n_bytes, shard (its hash prefix in bits after a 'b'), depth, shard_bytes and oversized of
    every row; `row` tells rows of one key apart, by default by where they lie."""
    hashed = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    row = F.md5((F.monotonically_increasing_id() if row is None else row).cast("string").cast("binary"))
    rows = docs.select(
        *keep,
        F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_bytes"),
        # 60 bits each
        F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long").alias("key_bits"),
        F.conv(F.substring(row, 1, 15), 16, 10).cast("long").alias("row_bits"),
    )
    open_rows = materialize(rows, "shard-rows").withColumn("path", F.lit("b"))
    done: DataFrame | None = None
    for k in range(ROUNDS):
        word = F.shiftright("key_bits" if k < ROUNDS // 2 else "row_bits", 60 - STEP * (k % 5 + 1)).bitwiseAND((1 << STEP) - 1)
        open_rows = open_rows.withColumn("word", word)
        cells = open_rows.groupBy("path", "word").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))
        cells = materialize(cells, "shard-cells", narrow=True)
        levels = cells.select("path", "word", "bytes", "n", F.explode(F.sequence(F.lit(0), F.lit(STEP))).alias("depth"))
        levels = levels.withColumn("prefix", F.expr(f"shiftright(word, {STEP} - depth)"))
        sums = levels.groupBy("path", "depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("n_rows"))
        fits = sums.where((F.col("shard_bytes") <= limit_bytes) | (F.col("n_rows") == 1) | ((F.lit(k) == ROUNDS - 1) & (F.col("depth") == STEP)))
        fits = materialize(fits.select("path", "depth", "prefix", "shard_bytes"), "shard-fits", narrow=True)
        chosen = join_checked(levels.select("path", "word", "depth", "prefix"), fits, ["path", "depth", "prefix"], "inner", limit=DIRECTORY_ROWS)
        directory = chosen.groupBy("path", "word").agg(F.min_by(F.struct("depth", "prefix", "shard_bytes"), "depth").alias("at"))
        joined = join_checked(open_rows, materialize(directory, "shard-directory", narrow=True), ["path", "word"], limit=DIRECTORY_ROWS)
        bits = F.when(F.col("at.depth") > 0, F.expr("lpad(bin(at.prefix), at.depth, '0')")).otherwise("")
        placed = joined.where(F.col("at").isNotNull()).select(
            *keep,
            "n_bytes",
            F.concat("path", bits).alias("shard"),
            (F.col("at.depth") + STEP * k).cast("int").alias("depth"),
            F.col("at.shard_bytes").alias("shard_bytes"),
            (F.col("at.shard_bytes") > limit_bytes).alias("oversized"),
        )
        done = placed if done is None else done.unionByName(placed)
        left = joined.where(F.col("at").isNull()).select(*keep, "n_bytes", "key_bits", "row_bits", F.concat("path", F.expr(f"lpad(bin(word), {STEP}, '0')")).alias("path"))
        if left.isEmpty():
            break
        open_rows = materialize(left, "shard-open")
    return done


def write_shards(docs: DataFrame, path: str, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """Write the documents, all their columns, in one folder for each shard; the result is the directory: shard,
    n_rows, shard_bytes. Rows are numbered once, so null and repeated ids keep their rows; a task holds one shard, which
    the limit bounds. A column `shard` of the documents is not allowed, as the folders are named by it."""
    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "shard-documents")
    placed = materialize(shards(numbered, limit_bytes, ("__row",), F.col("__row")), "shard-places")
    numbered.join(placed.select("__row", "shard"), "__row").drop("__row").repartition("shard").write.partitionBy("shard").parquet(path)
    return placed.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("n_bytes").alias("shard_bytes"))


def sql(limit_bytes: int) -> str:
    """The same in SQL for tables whose ids are unique."""
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS bits
  FROM documents),
l AS (SELECT doc_id, n_bytes, depth, bits >> (60 - depth)::INT AS prefix FROM d, (SELECT unnest(range(0, 40))::INT AS depth)),
s AS (SELECT *, (sum(n_bytes) OVER w)::BIGINT AS shard_bytes, count(*) OVER w AS n FROM l WINDOW w AS (PARTITION BY depth, prefix)),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k FROM s WHERE shard_bytes <= {limit_bytes} OR n = 1)
SELECT doc_id, n_bytes, 'b' || CASE WHEN depth > 0 THEN right(lpad(bin(prefix), 64, '0'), depth) ELSE '' END AS shard, depth, shard_bytes,
       shard_bytes > {limit_bytes} AS oversized
FROM f WHERE k = 1
"""
