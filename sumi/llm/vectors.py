"""Near-duplicate vectors by sorted projection passes.

Each pass hashes every vector to 64 signs of random projections, orders all vectors by that bit string, cuts the
order into blocks, and compares each block with itself and the next, so every vector meets at least the `block`
vectors that follow it; cosines are exact, in double precision. A pair of cosine c agrees in the first n bits with a
probability of (1 - acos(c) / pi) ** n, so the number of passes that leaves at most `miss` of the pairs at the
threshold follows from the number of vectors.

Equal vectors are one class from the start, counted, never paired. A pair that an earlier pass compared is known
from the block numbers its rows carry, so each pair is counted once without a list of pairs: tasks send the sums of
links of each vector and a spanning forest of what they linked. Where links span a whole window (a group larger than
a block), the blocks of that run are compared with each other in tasks of two blocks, so no window hides a link; rows
that shared a run in an earlier pass are not multiplied again.

A row that is moved holds its vector as it came (4 bytes a component of floats), its block in each pass (4 bytes) and
its place; numbers of runs are carried by the rows in runs only.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; shorter
vectors are filled up with zeros; repeated rows are equal vectors; an empty table gives no rows; a null id is kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import join_checked, materialize
from .graph import components

COSINE = 0.95
BLOCK = 1024
BLOCKS_IN_TASK = 16
MISS = 1e-4
SEED = 3
FOUND = "uid long, n long, other long, pass int, block long"


def n_passes(n: int, cosine: float, block: int, miss: float = MISS) -> int:
    bits = math.log2(max(2.0, 2.0 * n / block))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return max(4, math.ceil(math.log(miss) / math.log(1 - agree)))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Unit rows in double precision."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())
    if (offsets == dims).all():
        out = flat.reshape(-1, dims)
    else:
        out, at = np.zeros((len(offsets), dims)), 0
        for i, n in enumerate(offsets):
            out[i, :n], at = flat[at : at + n], at + n
    out = out / np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _keys(classes: DataFrame, dims: int, passes: int, seed: int) -> DataFrame:
    """uid, pass, key: the signs of 64 projections, as a number that sorts like the bit string."""

    def run(batches):
        planes = [np.random.default_rng([seed, k]).normal(size=(dims, 64)) for k in range(passes)]
        place = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            keys = [((x @ plane > 0) * place).sum(axis=1, dtype=np.uint64) for plane in planes]
            flat = (np.column_stack(keys) ^ np.uint64(1 << 63)).view(np.int64).reshape(-1)
            offsets = np.arange(len(x) + 1, dtype=np.int32) * passes
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["uid", "keys"])

    return classes.select("uid", "embedding").mapInArrow(run, "uid long, keys array<long>").select("uid", F.posexplode("keys").alias("pass", "key"))


def _places(keys: DataFrame, block: int) -> DataFrame:
    """uid, pass, place: the row's number in the order of all passes, by sorted ranges and their sizes."""
    order = ["pass", "key", "uid"]
    ranked = keys.repartitionByRange(*order).sortWithinPartitions(*order).select("uid", "pass", F.monotonically_increasing_id().alias("at"))
    ranked = materialize(ranked.select("uid", "pass", F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND((1 << 33) - 1).alias("row")), "ranked", narrow=True)
    sizes = ranked.groupBy("range").agg(F.count("*").alias("n"))  # a row for each range
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return join_checked(ranked, sizes.select("range", before.alias("before")), "range", "inner").select("uid", "pass", (F.col("row") + F.col("before")).alias("place"))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that links reach, for each row."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


class _Rows:
    """The rows of one task as arrays; `runs` only where the rows carry them."""

    def __init__(self, table: pa.Table, dims: int, passes: int, block: int):
        table = table.combine_chunks()
        get = lambda name: table[name].combine_chunks() if isinstance(table[name], pa.ChunkedArray) else table[name]
        self.uid, self.place, self.kind, self.copies = (get(c).to_numpy() for c in ("uid", "place", "pass", "copies"))
        self.block = self.place // block
        self.x = _matrix(get("embedding"), dims)
        self.blocks = get("blocks").flatten().to_numpy().reshape(-1, passes)
        if "runs" in table.column_names:
            self.runs = get("runs").flatten().to_numpy().reshape(-1, passes)


def _result(rows: _Rows, pairs: list[tuple[np.ndarray, np.ndarray]], flags: set[tuple[int, int]]) -> pa.Table:
    a, b = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in range(2))
    n = len(rows.uid)
    links = np.bincount(a, rows.copies[b], n).astype(np.int64) + np.bincount(b, rows.copies[a], n).astype(np.int64)
    low = _forest(n, a, b)
    at = np.flatnonzero(links)
    joined = np.flatnonzero(low != np.arange(n))
    marks = np.array(sorted(flags), np.int64).reshape(-1, 2)
    parts = [
        (rows.uid[at], links[at], None, None, None),
        (rows.uid[joined], None, rows.uid[low[joined]], None, None),
        (None, None, None, marks[:, 0].astype(np.int32), marks[:, 1]),
    ]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    sizes = (len(at), len(joined), len(marks))
    tables = [pa.table([pa.nulls(m, k) if c is None else pa.array(c, k) for c, k in zip(part, kinds, strict=True)], names=["uid", "n", "other", "pass", "block"]) for part, m in zip(parts, sizes, strict=True)]
    return pa.concat_tables(tables)


def _windows(items: DataFrame, dims: int, passes: int, cosine: float, block: int, together: int) -> DataFrame:
    """Compare each block with itself and the next; several blocks in a task."""
    at = F.floor(F.col("place") / block)
    own = F.floor(at / together)
    tasks = F.when((at % together == 0) & (at > 0), F.array(own, own - 1)).otherwise(F.array(own))

    def run(table: pa.Table) -> pa.Table:
        rows, pairs, flags = _Rows(table, dims, passes, block), [], set()
        task = table["task"][0].as_py()
        for k in range(task * together, (task + 1) * together):
            here, there = np.flatnonzero(rows.block == k), np.flatnonzero((rows.block == k) | (rows.block == k + 1))
            if not len(here):
                continue
            i, j = np.nonzero(rows.x[here] @ rows.x[there].T >= cosine)
            a, b = here[i], there[j]
            ok = (rows.kind[a] == rows.kind[b]) & (rows.place[a] < rows.place[b])
            a, b = a[ok], b[ok]
            wide = rows.place[b] - rows.place[a] >= block
            flags |= {(int(p), k) for p in np.unique(rows.kind[a[wide]])}
            earlier = np.arange(passes)[None, :] < rows.kind[a][:, None]
            seen = ((np.abs(rows.blocks[a] - rows.blocks[b]) <= 1) & earlier).any(axis=1)
            pairs.append((a[~seen], b[~seen]))
        return _result(rows, pairs, flags)

    return items.withColumn("task", F.explode(tasks)).groupBy("task").applyInArrow(run, FOUND)


def _runs(items: DataFrame, runs: DataFrame, dims: int, passes: int, cosine: float, block: int) -> DataFrame:
    """Compare the blocks of a run that are not neighbours; two blocks in a task."""
    at = F.floor(F.col("place") / block)
    mine = items.withColumn("block", at).join(F.broadcast(runs) if runs.count() <= 10_000 else runs, (F.col("pass") == F.col("run_pass")) & F.col("block").between(F.col("low"), F.col("high")))
    others = F.sequence(F.col("low"), F.col("high"))
    other = mine.withColumn("other", F.explode(others)).where(F.abs(F.col("other") - F.col("block")) >= 2)
    tasks = other.withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")})

    def run(table: pa.Table) -> pa.Table:
        rows = _Rows(table, dims, passes, block)
        left, right, k = table["left"][0].as_py(), table["right"][0].as_py(), table["pass"][0].as_py()
        here, there = np.flatnonzero(rows.block == left), np.flatnonzero(rows.block == right)
        one, other = rows.runs[here, :k], rows.runs[there, :k]
        # a run that all of one block shared with rows of the other in an earlier pass
        common = np.flatnonzero((one == one[0]).all(axis=0) & (one[0] >= 0)) if len(here) else []
        there = there[~(other[:, common] == one[0][common]).any(axis=1)] if len(common) else there
        i, j = np.nonzero(rows.x[here] @ rows.x[there].T >= cosine)
        a, b = here[i], there[j]
        same = ((rows.runs[a, :k] == rows.runs[b, :k]) & (rows.runs[a, :k] >= 0)).any(axis=1)
        ok = ~same & ~(np.abs(rows.blocks[a] - rows.blocks[b]) <= 1).any(axis=1)
        return _result(rows, [(a[ok], b[ok])], set())

    return tasks.drop("low", "high", "run_pass", "run", "other", "block").groupBy("pass", "left", "right").applyInArrow(run, FOUND)


def near_vectors(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, miss: float = MISS, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    base = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long"), (F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")).alias("embedding"))
    base = base.withColumn("embedding", F.when(F.coalesce(sound, F.lit(False)), F.col("embedding")))
    base = base.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    base = materialize(base, "vectors")
    good = base.where(F.col("embedding").isNotNull())
    classes = good.groupBy("h1", "h2").agg(F.min("uid").alias("uid"), F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.min_by("embedding", "uid").alias("embedding"))
    classes = materialize(classes, "vector-classes")
    n, dims = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    passes = n_passes(n, cosine, block, miss)
    placed = materialize(_places(_keys(classes, dims, passes, seed), block).withColumn("block", F.floor(F.col("place") / block)), "placed", narrow=True)
    number = F.col("block") - F.col("pass") * F.lit(n // block)  # small numbers that tell neighbours of one pass
    seats = placed.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("pass", "place", number.cast("int").alias("block")))).alias("at"))
    carried = classes.select("uid", "embedding", "copies").join(seats, "uid").withColumn("blocks", F.transform("at", lambda s: s["block"]))
    items = carried.select("uid", "embedding", "copies", "blocks", F.explode("at").alias("s")).select("uid", "embedding", "copies", "blocks", F.col("s.pass").alias("pass"), F.col("s.place").alias("place"))
    found = materialize(_windows(items, dims, passes, cosine, block, BLOCKS_IN_TASK), "windows")
    flags = found.where("pass is not null").select("pass", "block").distinct()
    runs = flags.withColumn("run", F.col("block") - F.row_number().over(Window.partitionBy("pass").orderBy("block")))
    runs = runs.groupBy(F.col("pass").alias("run_pass"), "run").agg(F.min("block").alias("low"), (F.max("block") + 1).alias("high")).where("high - low >= 2")
    runs = materialize(runs.withColumn("run", F.col("low")), "runs", narrow=True)
    if not runs.isEmpty():
        of_pass = placed.join(runs, (placed["pass"] == runs["run_pass"]) & placed["block"].between(runs["low"], runs["high"]), "left")
        by_uid = of_pass.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("pass", F.coalesce("run", F.lit(-1)).alias("run")))).alias("r"))
        by_uid = by_uid.select("uid", F.transform("r", lambda s: s["run"]).alias("runs"))
        far = _runs(items.join(by_uid, "uid"), runs, dims, passes, cosine, block)
        found = found.unionByName(materialize(far, "far"))
    links = found.where("n is not null").groupBy("uid").agg(F.sum("n").alias("n"))
    roots = components(found.where("other is not null").select(F.col("uid").alias("a"), F.col("other").alias("b")))
    classed = classes.select("h1", "h2", "uid", "least", "copies").join(links, "uid", "left").join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    smallest = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    per_class = classed.join(smallest, "root").select("h1", "h2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    linked = good.select("vec_id", "h1", "h2").join(per_class, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = base.where("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
