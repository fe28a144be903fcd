"""Quality scores: random-indexing word vectors pooled per document, a small network, calibrated by temperature.

Every token and every token shape (case, length, symbols, repeats) has a cell in a table of fixed size and a sparse
random index vector. One pass over all documents adds up, for each cell, the index vectors of its neighbours: the
context vectors, summed by Spark as one row for each cell and task. A second pass pools the centred, normalised
context vectors of each document's words and shapes, with a few rates (repeats, symbols, capitals). A two-layer
network is fitted in numpy on at most `max_train` labelled training ids, chosen by hash, one row for each; a part of
them that the network does not see sets the temperature that turns its margin into a probability.

The model's size is fixed; documents are not shuffled; the driver holds the table and the training rows only. All sums
are whole numbers and no word is a neighbour of another document's, so scores do not depend on how rows lie.

Edge cases: null and empty texts pool to zeros and get the score of that point; a null id has no label; repeated
labels of one id count as the larger; without labels of both classes all scores are the base rate.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import held_out, materialize, text_batches, training_labels

TABLE_BITS = 14
DIMS = 32
NONZERO = 4
MAX_TRAIN = 40_000
HIDDEN = 48
EPOCHS = 40
SEED = 7
TOKEN = re.compile(r"\w+|[^\w\s]+")
CACHE_TOKENS = 300_000
N_RATES = 8
LANE_ROWS = 4_000


def index_vectors(bits: int = TABLE_BITS, dims: int = DIMS, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((1 << bits, dims), np.int8)
    at = np.argsort(rng.random(out.shape), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.int8), at.shape), axis=1)
    return out


class TokenCells(dict):
    """Token to (word cell, shape cell) packed as one number, remembered."""

    def __init__(self, bits: int):
        super().__init__()
        self.bits, self.mask = bits, (1 << bits) - 1

    def __missing__(self, token: str) -> int:
        if len(self) > CACHE_TOKENS:
            self.clear()
        if token[0].isalnum() or token[0] == "_":
            case = "U" if token.isupper() and len(token) > 1 else "T" if token[0].isupper() else "l" if token.islower() else "d" if token.isdigit() else "m"
            shape = f"{case}{min(len(token), 16)}"
        else:
            shape = f"s{token[:3]}{min(len(token), 4)}"
        word = zlib.crc32(token.encode("utf-8", "surrogatepass")) & self.mask
        cell = self[token] = word << self.bits | zlib.crc32(b"\0" + shape.encode("utf-8", "surrogatepass")) & self.mask
        return cell

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        tokens = TOKEN.findall(text or "")
        both = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return both >> self.bits, both & self.mask


def _shift_sum(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    out[1:] += x[:-1]
    out[:-1] += x[1:]
    return out


def context_vectors(docs: DataFrame, bits: int = TABLE_BITS, dims: int = DIMS) -> np.ndarray:
    """For each cell the sum of its neighbours' index vectors over all documents."""
    names = [f"v{d}" for d in range(dims)]

    def run(batches):
        # one more cell, with a vector of zeros, stands between documents
        cells, index = TokenCells(bits), np.vstack([index_vectors(bits, dims), np.zeros((1, dims), np.int8)])
        total, size = np.zeros(((1 << bits) + 1, dims), np.int64), np.zeros((1 << bits) + 1, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        between = np.array([1 << bits])

        def flush():
            words, shapes = (np.concatenate([h[i] for h in held]) for i in range(2))
            held.clear()
            if not len(words):
                return
            by_word, by_shape = index[words], index[shapes]
            near = _shift_sum(by_word + by_shape)
            for ids, mine in ((words, by_shape), (shapes, by_word)):
                # rows of a cell together; small ids sort by radix
                ids = ids.astype(np.uint16)
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
                first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                parts = -(-np.diff(np.append(first, len(ids))) // LANE_ROWS)
                start = np.repeat(first, parts) + LANE_ROWS * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
                # four 16-bit sums in each 64-bit one: terms lie in 3..13, so LANE_ROWS of them fit
                lanes = (near + mine + np.int8(8)).astype(np.uint16)[order].view(np.uint64)
                sums = np.add.reduceat(lanes, start, axis=0).view(np.uint16).astype(np.int64)
                rows = np.diff(np.append(start, len(ids)))
                np.add.at(total, ids[start], sums - 8 * rows[:, None])
                np.add.at(size, ids[start], rows)

        waiting = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                one = cells.of(text)
                held += [one, (between, between)]
                waiting += len(one[0])
                if waiting > 200_000:
                    flush()
                    waiting = 0
        if held:
            flush()
        used = np.flatnonzero(size[:-1])
        for at in range(0, len(used), 10_000):
            part = used[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(total[part, d]) for d in range(dims))], names=["cell", *names])

    each = docs.select("text").mapInArrow(run, "cell long, " + ", ".join(f"{n} long" for n in names))
    with text_batches(docs.sparkSession):
        rows = each.groupBy("cell").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    out = np.zeros((1 << bits, dims))
    out[rows["cell"].to_numpy()] = np.column_stack([rows[n].to_numpy() for n in names]) if rows.num_rows else 0
    return out


def normalised(context: np.ndarray) -> np.ndarray:
    """Unit vectors less their common direction; cells never seen are zero."""
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    seen = norm[:, 0] > 0
    out = np.where(norm > 0, context / np.maximum(norm, 1e-12), 0)
    if seen.any():
        out[seen] -= out[seen].mean(axis=0)
    return out.astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and `features`: mean word vector, mean shape vector, and rates."""
    bits, dims = int(np.log2(len(vectors))), vectors.shape[1]
    rows = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def features(cells: TokenCells, text: str | None) -> np.ndarray:
        words, shapes = cells.of(text)
        n = len(words)
        out = np.zeros(2 * dims + N_RATES, np.float32)
        if not n:
            return out
        out[:dims], out[dims : 2 * dims] = vectors[words].mean(axis=0), vectors[shapes].mean(axis=0)
        pairs = np.unique(words[:-1] << bits | words[1:])
        text = text or ""
        out[2 * dims :] = (
            np.log1p(n),
            (words[1:] == words[:-1]).mean() if n > 1 else 0,
            len(pairs) / max(1, n - 1),
            len(np.unique(words)) / n,
            text.count("\n") / n,
            len(text) / n,
            len(np.unique(shapes)) / n,
            (vectors[words[1:]] * vectors[words[:-1]]).sum(axis=1).mean() if n > 1 else 0,
        )
        return out

    def run(batches):
        cells = TokenCells(bits)
        for batch in batches:
            found = [features(cells, t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            flat = np.concatenate(found) if found else np.zeros(0, np.float32)
            offsets = np.arange(len(found) + 1, dtype=np.int32) * (2 * dims + N_RATES)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[*keep, "features"])

    return rows.mapInArrow(run, f"{schema}, features array<float>")


class Network:
    """Two layers; standardised inputs; logits divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = (x - self.mean) / self.scale
        order = rng.permutation(len(z))
        aside, fit = order[: len(z) // 5], order[len(z) // 5 :]
        base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.w = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), np.zeros(hidden), np.array(np.log(base / (1 - base)))]
        self.temperature = 1.0
        if not 0 < y.mean() < 1:
            return
        m, v, t = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w], 0
        self.w[2] = rng.normal(0, 1 / np.sqrt(hidden), hidden)
        for epoch in range(epochs):
            rate = 3e-3 * (1 - epoch / epochs) + 1e-5
            for part in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
                zb, yb = z[part], y[part]
                h = np.tanh(zb @ self.w[0] + self.w[1])
                p = 1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -30, 30)))
                d = (p - yb) / max(1, len(part))
                dh = np.outer(d, self.w[2]) * (1 - h * h)
                grads = [zb.T @ dh + 1e-4 * self.w[0], dh.sum(axis=0), h.T @ d + 1e-4 * self.w[2], d.sum()]
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        if len(aside) and 0 < y[aside].mean() < 1:
            logits = self.logits(x[aside])
            tries = np.exp(np.linspace(np.log(0.3), np.log(10), 200))
            loss = [np.logaddexp(0, np.where(y[aside] == 1, -1, 1) * logits / t).mean() for t in tries]
            self.temperature = float(tries[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def score(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    few = training_labels(labels, "quality", max_train)
    vectors = normalised(context_vectors(docs))
    rows = materialize(pooled(docs, vectors), "pooled")
    train = rows.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("features").alias("features"), F.max("__y").alias("__y")).toArrow()
    width = 2 * DIMS + N_RATES
    x = train["features"].combine_chunks().flatten().to_numpy().reshape(-1, width).astype(np.float64) if train.num_rows else np.zeros((1, width))
    y = train["__y"].to_numpy().astype(np.float64) if train.num_rows else np.array([0.5])
    order = train["doc_id"].to_pandas().argsort().to_numpy() if train.num_rows else np.array([0])
    network = Network(x[order], y[order])

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, width).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network.probability(x))], names=["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.select("doc_id", "features").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
