"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A document is its five-word shingles (lower-case words), each weighted by how often it occurs there (TF) times its
IDF. Counting all different five-word strings of a corpus takes a table that grows with it, and a table of fixed size
counts collisions in the end; so a shingle's IDF is the mean of its words', which is what its own document count would
say if words were independent. A word's IDF is ln((1 + docs) / (1 + df)) / ln(1 / RARE) up to 1, df its document count
over all documents: it depends on the share of documents that have the word, not on how many there are. Words rarer
than RARE count alike; what unlike rare words add to one cell of the hashed table of 2 ** TABLE_BITS is the rare words
of a document / 2 ** TABLE_BITS of all documents, below RARE at any corpus size. A passage that many documents share
keeps its weight, so copies in a large group are not told apart by the one word that they do not share.

The IDF is rounded to one of 16 levels, which are part of the shingle's hash: weights need no table later on.

Sampling (Ioffe 2010): for hash i and shingle k with weight S, r and c are Gamma(2, 1), b uniform, all fixed by
(i, k); t = floor(ln S / r + b), ln a = ln c - r (t - b) - r; the shingle with the smallest a, with its t, is the
sample. Two documents agree in a sample with a probability of their weighted Jaccard similarity. (r, c, b) come from
a pool that (i, k) indexes, and weights are put on a logarithmic grid, so a draw is one table look-up. Samples are
banded; documents that share a band's key are candidates.

Equal word sequences are one node from the start. In a bucket all members are verified against its smallest node,
by exact weighted Jaccard similarity. Members that are not similar to it stay, and so do similar ones that may yet
link with those by the triangle inequality of the weighted Jaccard distance. Buckets whose members are one component
by now are done. What stays is compared within its bucket in blocks of bounded size, by products of sparse weight
matrices, and only a spanning forest of the links leaves a task. So no bucket is expanded into its pairs and nothing
is dropped for its size. Classes are the links' connected components.

Edge cases: texts of one to four words are one shingle; null, empty and blank texts are alike, other texts without words are
like equal ones only; a null
id is last when a class's first document is picked; repeated rows are rows of one node and one of them is kept.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import join_checked, materialize, row_key, text_batches, tidy
from .graph import components

WORDS = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 5
TABLE_BITS = 18
RARE = 1e-3  # words in a smaller share of documents have the IDF 1
POOL_BITS = 16
STEP = 3 / 16  # of ln weight, for levels of IDF and for the grid of sampling
LEVEL_BITS = 4
LEVELS = np.exp(-STEP * np.arange(1 << LEVEL_BITS))  # the IDF of each level, 0.06 at least
UNIT = 1024  # a word's IDF is a whole number of these parts, so that sums are exact
SEED = 5
WORD = re.compile(r"\w+")
CACHE_WORDS = 200_000
CHUNK = 1024  # shingles that are drawn for at once
BLOCK = 512  # members of a bucket in a block
BLOCK_SHINGLES = 1 << 19  # and shingles of theirs; a longer document is a block of its own
COLUMNS = 4096


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """Words to 64-bit hashes, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        raw = word.encode("utf-8", "surrogatepass")
        h = self[word] = zlib.crc32(raw) << 32 | zlib.adler32(raw)
        return h


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def word_idf(docs: DataFrame, bits: int = TABLE_BITS) -> np.ndarray:
    """The IDF of each cell of the hashed table of words, in whole parts of 1 / UNIT."""
    size, shift = 1 << bits, 64 - bits

    def run(batches):
        hashes, total = WordHashes(), np.zeros(size + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = set(words_of(text))
                h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
                total[np.unique(h >> np.uint64(shift)).astype(np.intp)] += 1
                total[size] += 1
        used = np.flatnonzero(total)
        for at in range(0, len(used), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(used[at : at + 10_000]), pa.array(total[used[at : at + 10_000]])], names=["cell", "n"])

    with text_batches(docs.sparkSession):
        rows = docs.select("text").mapInArrow(tidy(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(size + 1)
    df[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) / math.log(1 / RARE)
    return np.rint(UNIT * np.clip(idf, 0, 1)).astype(np.uint16)


class Shingler:
    """Texts to sorted 32-bit shingles, one for each occurrence: 28 bits of hash, then the level of the IDF."""

    def __init__(self, idf: np.ndarray, words: int = WORDS):
        self.hashes, self.idf, self.words = WordHashes(), idf.astype(np.int64), words
        self.shift = np.uint64(64 - int(math.log2(len(idf))))
        mean = np.maximum(np.arange(UNIT + 1) / UNIT, 1e-9)
        self.level = np.clip(np.rint(-np.log(mean) / STEP), 0, len(LEVELS) - 1).astype(np.uint64)

    def of(self, text: str | None) -> tuple[bytes, np.ndarray]:
        """A digest of the word sequence (without words, of the text less outer blanks), and the shingles."""
        found = words_of(text)
        h = np.fromiter(map(self.hashes.__getitem__, found), np.uint64, len(found))
        if not len(h):
            blank = (text or "").strip().encode("utf-8", "surrogatepass")
            return hashlib.blake2b(blank, digest_size=16, person=b"no words").digest(), np.zeros(0, np.uint32)
        digest = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
        k = min(self.words, len(h))
        total = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            total = total * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(total)]
        sums = np.concatenate([[0], np.cumsum(self.idf[(h >> self.shift).astype(np.intp)])])
        level = self.level[(sums[k:] - sums[:-k]) // k]
        both = _mix(total) >> np.uint64(32 + LEVEL_BITS) << np.uint64(LEVEL_BITS) | level
        return digest, np.sort(both.astype(np.uint32))


def weigh(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a sorted array, how often each occurs, and its level."""
    first = np.flatnonzero(np.concatenate([[True], shingles[1:] != shingles[:-1]])) if len(shingles) else np.zeros(0, np.intp)
    kinds = shingles[first]
    return kinds, np.diff(np.append(first, len(shingles))), (kinds & np.uint32(len(LEVELS) - 1)).astype(np.intp)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted shingle arrays."""
    (ka, na, la), (kb, nb, lb) = weigh(a), weigh(b)
    if not len(ka) or not len(kb):
        return float(len(ka) == len(kb))
    at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    both = kb[at] == ka
    common = float((np.minimum(na[both], nb[at[both]]) * LEVELS[la[both]]).sum())
    return common / (float((na * LEVELS[la]).sum()) + float((nb * LEVELS[lb]).sum()) - common)


class Sampler:
    """Improved consistent weighted sampling, banded."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = SEED):
        rng, n, pool = np.random.default_rng(seed), bands * rows, 1 << POOL_BITS
        self.bands, self.rows = bands, rows
        self.r, self.c, self.b = rng.gamma(2, 1, pool), rng.gamma(2, 1, pool), rng.random(pool)
        self.mul = rng.integers(1, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.space = np.empty(n * CHUNK, np.uint32), np.empty(n * CHUNK, np.intp), np.empty(n * CHUNK, np.float32)
        self.levels: dict[int, int] = {}
        self.ln_a = np.zeros((0, pool), np.float32)

    def _t(self, step, at=slice(None)) -> np.ndarray:
        return np.floor(step * STEP / self.r[at] + self.b[at])

    def _level(self, step: int) -> int:
        """The place of a step of the weight grid in the look-up table, made when it first occurs."""
        if step not in self.levels:
            ln_a = np.log(self.c) - self.r * (self._t(step) - self.b) - self.r
            self.levels[step] = len(self.ln_a)
            self.ln_a = np.vstack([self.ln_a, ln_a.astype(np.float32)])
        return self.levels[step]

    def keys(self, shingles: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band; `steps` are the weights on the grid, ln weight / STEP."""
        kinds, which = np.unique(steps, return_inverse=True)
        level = np.array([self._level(int(s)) for s in kinds], np.intp)[which] << POOL_BITS
        ln_a, n = self.ln_a.reshape(-1), len(self.mul)
        best, pick, cell, row = np.full(n, np.inf, np.float32), np.zeros(n, np.intp), np.zeros(n, np.intp), np.arange(n)
        for at in range(0, len(shingles), CHUNK):
            some = shingles[at : at + CHUNK]
            m = len(some)
            product, index, drawn = (x[: n * m].reshape(n, m) for x in self.space)
            np.multiply(some[None, :], self.mul[:, None], out=product)
            np.right_shift(product, np.uint32(32 - POOL_BITS), out=product)
            np.add(product, level[None, at : at + CHUNK], out=index, casting="unsafe")
            np.take(ln_a, index, out=drawn, mode="clip")
            k = drawn.argmin(axis=1)
            low = drawn[row, k]
            better = low < best
            best[better], pick[better] = low[better], k[better] + at
            cell[better] = index[row, k][better]
        t = self._t(steps[pick], cell & ((1 << POOL_BITS) - 1)).astype(np.int64).astype(np.uint32)
        sample = _mix(shingles[pick].astype(np.uint64) << np.uint64(32) | t.astype(np.uint64))
        sample = sample.reshape(self.bands, self.rows)
        key = np.arange(self.bands, dtype=np.uint64)
        for i in range(self.rows):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + sample[:, i])
        return key.view(np.int64)


def grid_steps(n: np.ndarray, level: np.ndarray) -> np.ndarray:
    """ln weight in steps of the grid."""
    return np.rint(np.log(n) / STEP).astype(np.int64) - level


def sample(docs: DataFrame, idf: np.ndarray, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """uid, doc_id, row_key, node (digest of the words), keys (one for each band; none without words), shingles."""
    source = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", row_key(docs).alias("row_key"), "text")

    def run(batches):
        shingler, sampler = Shingler(idf, words), Sampler(bands, rows)
        for batch in batches:
            nodes, keys, shingles, known = [], [], [], {}
            for text in batch.column(3).to_pylist():
                node, found = shingler.of(text)
                if node not in known:
                    kinds, n, level = weigh(found)
                    known[node] = sampler.keys(kinds, grid_steps(n, level)) if len(found) else np.zeros(0, np.int64)
                nodes.append(node)
                shingles.append(found.tobytes())
                keys.append(known[node])
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(nodes, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(shingles, pa.binary())],
                names=["uid", "doc_id", "row_key", "node", "keys", "shingles"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(tidy(run), f"uid long, doc_id {kind}, row_key struct<a:long,b:long>, node binary, keys array<long>, shingles binary")


def verified(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """(leader, uid, d): the weighted Jaccard distance of each pair."""
    both = pairs.join(shingles.select(F.col("uid").alias("leader"), F.col("shingles").alias("x")), "leader").join(shingles.withColumnRenamed("shingles", "y"), "uid")

    def run(batches):
        for batch in batches:
            xs, ys = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            d = [1.0 - similarity(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(xs, ys, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d, pa.float64())], names=["leader", "uid", "d"])

    return both.select("leader", "uid", "x", "y").mapInArrow(tidy(run), "leader long, uid long, d double")


def _unresolved(members: DataFrame, checked: DataFrame, far: float) -> DataFrame:
    """(bucket, uid) that the star around each bucket's leader leaves open: members that are not similar to it, and
    similar ones that may yet link with those by the triangle inequality. `members` has bucket, uid, size and leader."""
    at = members.where("uid <> leader").join(checked, ["leader", "uid"])
    nearest = at.where(F.col("d") > far).groupBy("bucket").agg(F.min("d").alias("nearest"))
    return join_checked(at, nearest, "bucket", "inner").where((F.col("d") > far) | (F.col("d") >= F.col("nearest") - far)).select("bucket", "uid", "size")


def _grouped(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, uid) in buckets whose members have several components yet."""
    rooted = members.join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    several = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    return join_checked(rooted, several, "bucket", "inner").select("bucket", "uid", "size")


def links(nodes: DataFrame, shingles: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(node, root): the components of all verified links; `nodes` has uid, size (its shingles) and keys, `shingles` uid and shingles."""
    far = 1.0 - least
    exploded = nodes.select("uid", "size", F.posexplode("keys").alias("band", "key"))
    buckets = exploded.groupBy("band", "key").agg(F.min("uid").alias("leader"), F.count("*").alias("n")).where("n > 1")
    members = materialize(exploded.join(buckets.select("band", "key", "leader"), ["band", "key"]), "members")
    candidates = materialize(join_checked(shingles, members.select("uid").distinct(), "uid", "inner"), "candidates")
    checked = materialize(verified(members.where("uid <> leader").select("leader", "uid").distinct(), candidates), "verified")
    near = lambda found: found.where(F.col("d") <= far).select(F.col("leader").alias("a"), F.col("uid").alias("b"))
    roots = components(near(checked))
    open_ = materialize(_unresolved(members.select(F.struct("band", "key").alias("bucket"), "uid", "size", "leader"), checked, far), "open", narrow=True)
    open_ = materialize(_grouped(open_, roots), "open-groups", narrow=True)
    return _merged(roots, _within(open_, candidates, least))


def _within(open_: DataFrame, shingles: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(a, b): a spanning forest of the links between the members of each bucket. Buckets are cut into blocks, by
    members and by their shingles, and a task gets two blocks at most, so its size is bounded; it sends no more rows
    than it has members."""
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / BLOCK_SHINGLES))
    buckets = open_.groupBy("bucket").agg(blocks.cast("int").alias("n_blocks"))
    mine = F.pmod(F.xxhash64("uid"), F.col("n_blocks")).cast("int")
    dealt = join_checked(open_, buckets, "bucket", "inner").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    tasks = dealt.select("uid", F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"))

    def run(table: pa.Table) -> pa.Table:
        uid = table["uid"].to_numpy()
        found = [np.frombuffer(x, np.uint32) for x in table["shingles"].to_pylist()]
        first = [np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) for x in found]
        # the k-th occurrence of a shingle in a document is a feature of its own
        nth = [np.arange(len(x)) - np.repeat(f, np.diff(np.append(f, len(x)))) for x, f in zip(found, first, strict=True)]
        features = np.concatenate(found).astype(np.uint64) << np.uint64(32) | np.concatenate(nth).astype(np.uint64)
        owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
        weight = LEVELS[(features >> np.uint64(32)).astype(np.intp) & (len(LEVELS) - 1)]
        total = np.bincount(owner, weight, len(found))
        kinds, column, seen = np.unique(features, return_inverse=True, return_counts=True)
        shared = seen[column] > 1
        owner, weight, column = owner[shared], weight[shared], (np.cumsum(seen > 1) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        owner, weight, column = owner[order], weight[order], column[order]
        common = np.zeros((len(found), len(found)))
        for at in range(0, int((seen > 1).sum()), COLUMNS):
            a, b = np.searchsorted(column, (at, at + COLUMNS))
            has = np.zeros((len(found), COLUMNS), np.float32)
            has[owner[a:b], column[a:b] - at] = np.sqrt(weight[a:b])
            common += has @ has.T
        sim = common / (total[:, None] + total[None, :] - common)
        i, j = np.nonzero(np.triu(sim >= least - 1e-4, 1))
        sure = np.array([s > least + 1e-4 or similarity(found[a], found[b]) >= least for a, b, s in zip(i, j, sim[i, j], strict=True)], bool)
        label = np.arange(len(found))
        i, j = i[sure], j[sure]
        while True:
            low = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        at = np.flatnonzero(label != np.arange(len(found)))
        return pa.table([pa.array(uid[at]), pa.array(uid[label[at]])], names=["a", "b"])

    return tasks.join(shingles, "uid").groupBy("task").applyInArrow(run, "a long, b long").distinct()


def _merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The components after more links: those of the links' components are found, then every node follows its own."""
    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    both = edges.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    joined = components(materialize(both.distinct(), "root-links", narrow=True))
    moved = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    new = joined.join(roots.select("node"), "node", "left_anti").select("node", "root")
    return materialize(moved.unionByName(new), "roots", narrow=True)


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, samples: int = ROWS) -> DataFrame:
    """doc_id, class_id (the class's smallest id), class_size and kept (one row of each class) of every row, with the
    `row_key` of `base.row_key`; `bands` of `samples` each."""
    rows = materialize(sample(docs, word_idf(docs), bands=bands, rows=samples), "samples")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("uid").alias("uid")))
    groups = materialize(rows.groupBy("node").agg(F.min("uid").alias("uid"), first.alias("first"), F.count("*").alias("n")), "nodes")
    whole = rows.where(F.size("keys") > 0)
    alone = groups.select("uid")
    roots = links(join_checked(whole.select("uid", (F.length("shingles") / 4).cast("long").alias("size"), "keys"), alone, "uid", "inner"), whole.select("uid", "shingles"), least)
    classed = groups.join(roots, groups["uid"] == roots["node"], "left").select(groups["node"].alias("words"), F.coalesce("root", "uid").alias("root"), "first", "n")
    classes = classed.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("class_size"))
    by_node = classed.select("words", "root").join(classes, "root").select(F.col("words").alias("node"), "first", "class_size")
    out = rows.select("uid", "doc_id", "row_key", "node").join(by_node, "node")
    return out.select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("uid") == F.col("first.uid")).alias("kept"), "row_key")
