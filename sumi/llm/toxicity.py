"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme values.

Tokens are lower-case words. A word stands for itself and for its stems (its first 4 to 7 characters), each hashed
into a cell of a table of fixed size. Document counts over all documents give the Dirichlet prior, counts over the
labelled training rows the two classes. A word is scored by whichever of its cells has the most significant
log-odds (signed root deviance of at least `z_min`): the log likelihood ratio of that cell under these priors. All
other words drift down a little, so that scores fall on clean text, and the k-th occurrence of a word in a document
counts 1 / k of its score, as words come in bursts. One linear scan (Ruzzo and Tompa) finds every
maximal scoring segment of a document; it is a significant passage if lambda * score - ln(n tokens) exceeds
ln(1 / alpha), lambda from the Karlin-Altschul equation over the word scores of the clean training documents.
ln K of the extreme-value law is fitted to those documents, the passages of a document add up to one statistic, and
a logistic curve over all training documents turns it into a probability of label 1.

The model has a fixed size (2 ** TABLE_BITS cells); nothing else leaves the executors but histograms of fixed size.
At most MAX_LABELS labelled ids are learnt from, so they are broadcast at any size and documents are never shuffled;
the prior's counts and the scores are those of all documents.

Edge cases: null and empty texts get the score of no tokens; a null id is a training candidate without a label;
repeated labels of one id count as the larger; without labels of both classes all scores are the base rate.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import held_out, materialize, text_batches, tidy, training_labels

TABLE_BITS = 18
STEMS = (4, 5, 6, 7)
PRIOR = 10_000.0  # counts that the Dirichlet prior is worth
Z_MIN = 5.0
DRIFT = -0.05
ALPHA = 0.01
EDGES = np.linspace(-20.0, 60.0, 801)
SCORE_EDGES = np.linspace(-15.0, 15.0, 1201)
WORD = re.compile(r"\w+")
CACHE_WORDS = 150_000
MAX_LABELS = 1_000_000


class Words(dict):
    """What `value` makes of a word, remembered."""

    def __init__(self, value):
        super().__init__()
        self.value = value

    def __missing__(self, word: str):
        if len(self) > CACHE_WORDS:
            self.clear()
        out = self[word] = self.value(word)
        return out


def cells(word: str, mask: int) -> list[int]:
    """The cells of the word and of its stems."""
    raw = [word.encode("utf-8", "surrogatepass"), *(b"^" + word[:k].encode("utf-8", "surrogatepass") for k in STEMS if len(word) > k)]
    return [zlib.crc32(x) & mask for x in raw]


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end), disjoint, in linear time."""
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    # neighbouring positive tokens form one run; the negatives between are in the sums
    cut = np.flatnonzero(np.diff(at) > 1)
    starts, ends = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + 1
    found: list[list] = []  # left sum, right sum, start, end, link to the last one with a smaller left sum
    for i, j in zip(starts.tolist(), ends.tolist(), strict=True):
        left, right, start = sums[i], sums[j], i
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][0] >= left:
                k = found[k][4]
            if k < 0 or found[k][1] >= right:
                found.append([left, right, start, j, k])
                break
            left, start = found[k][0], found[k][2]
            del found[k:]
    return [(float(r - lft), s, e) for lft, r, s, e, _ in found]


def count_cells(docs: DataFrame, label: str, bits: int = TABLE_BITS) -> tuple[dict[str, np.ndarray], float, float]:
    """Documents with each cell, in all and by label, and the labelled documents. One row for each cell and task."""
    size = 1 << bits

    def run(batches):
        memo, total = Words(lambda w: cells(w, size - 1)), np.zeros((3, size + 1), np.int64)
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.fromiter(set().union(*map(memo.__getitem__, set(words(text)))), np.int64)
                for k in (0,) if y is None else (0, 1 + (y == 1)):
                    total[k, found] += 1
                    total[k, size] += 1
        used = np.flatnonzero(total[0])
        for at in range(0, len(used), 10_000):
            part = used[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(t[part]) for t in total)], names=["cell", "n", "n0", "n1"])

    each = docs.select("text", F.col(label).cast("int")).mapInArrow(tidy(run), "cell long, n long, n0 long, n1 long")
    with text_batches(docs.sparkSession):
        rows = each.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "n0", "n1"))).toArrow()
    out = {}
    for c in ("n", "n0", "n1"):
        out[c] = np.zeros(size + 1)
        out[c][rows["cell"].to_numpy()] = rows[c].to_numpy()
    return {c: v[:-1] for c, v in out.items()}, out["n0"][-1], out["n1"][-1]


def cell_scores(counts: dict[str, np.ndarray], docs0: float, docs1: float, prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood ratio of each cell under the prior, and its signed root deviance."""
    n, y0, y1 = counts["n"], counts["n0"], counts["n1"]
    if not docs0 or not docs1:
        return np.zeros(len(n)), np.zeros(len(n))
    alpha = prior * (n + 0.01) / (n + 0.01).sum()
    a0, a1 = y0 + alpha, y1 + alpha
    ratio = np.log(a1 / a1.sum()) - np.log(a0 / a0.sum())
    both, share = y0 + y1, docs1 / (docs0 + docs1)

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-300) / np.maximum(expected, 1e-300)), 0)

    rest = docs0 + docs1 - both
    deviance = 2 * (part(y1, both * share) + part(y0, both * (1 - share)) + part(docs1 - y1, rest * share) + part(docs0 - y0, rest * (1 - share)))
    return ratio, np.sign(y1 * docs0 - y0 * docs1) * np.sqrt(np.maximum(deviance, 0))


def word_scorer(ratio: np.ndarray, z: np.ndarray, z_min: float = Z_MIN, drift: float = DRIFT):
    mask = len(ratio) - 1

    def value(word: str) -> float:
        best = max(cells(word, mask), key=lambda c: abs(z[c]))
        return float(ratio[best]) if abs(z[best]) >= z_min else drift

    return value


def damp(tokens: list[str], scores: np.ndarray) -> np.ndarray:
    """Scores of a document's words in which the k-th occurrence of a word counts 1 / k of its score if that is
    positive: words come in bursts, so a repeat is less evidence than the first."""
    times: dict[str, int] = {}
    for i in np.flatnonzero(scores > 0).tolist():
        k = times[tokens[i]] = times.get(tokens[i], 0) + 1
        scores[i] /= k
    return scores


SEGMENT = "array<struct<score:double,start:int,end:int>>"


def segment_rows(docs: DataFrame, label: str, ratio: np.ndarray, z: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, n_tokens and all maximal segments of each document; and, with `bin`, how many words of the
    documents with label 0 have a score in each bin."""
    rows = docs.select(*keep, F.col("text").alias("__text"), F.col(label).cast("int").alias("__label"))
    segment = pa.struct([("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])
    kinds, names = (pa.int64(), pa.list_(segment), pa.int32(), pa.int64()), [*keep, "n_tokens", "segments", "bin", "bin_words"]

    def arrays(found):
        return [pa.array(c, k) for c, k in zip(list(zip(*found, strict=True)) or [()] * 4, kinds, strict=True)]

    def run(batches):
        memo, seen, kept = Words(word_scorer(ratio, z)), np.zeros(len(SCORE_EDGES) + 1, np.int64), None
        for batch in batches:
            found, kept = [], [batch.column(i).type for i in range(len(keep))]
            for text, y in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist(), strict=True):
                tokens = words(text)
                scores = damp(tokens, np.fromiter(map(memo.__getitem__, tokens), np.float64, len(tokens)))
                if y == 0:
                    seen += np.bincount(np.searchsorted(SCORE_EDGES, scores), minlength=len(seen))
                found.append((len(tokens), [{"score": s, "start": a, "end": b} for s, a, b in segments(scores)], None, None))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *arrays(found)], names=names)
        used = np.flatnonzero(seen)
        if len(used):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(used), k) for k in kept), *arrays([(None, None, int(k), int(seen[k])) for k in used])], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(tidy(run), f"{schema}, n_tokens long, segments {SEGMENT}, bin int, bin_words long")


def karlin_lambda(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1; 8 at most, where hardly a score is positive."""
    if not counts.sum():
        return 1.0
    p, low, high = counts / counts.sum(), 1e-3, 8.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if p @ np.exp(mid * scores) < 1 else (low, mid)
    return high


def fit_logistic(x: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple[float, float]:
    """Intercept and slope for counts of both classes at each x, with a weak pull to 0."""
    a = b = 0.0
    n = n0 + n1
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = n * p * (1 - p) + 1e-9
        g = np.array([(n1 - n * p).sum() - 1e-3 * a, ((n1 - n * p) * x).sum() - 1e-2 * b])
        h = np.array([[w.sum() + 1e-3, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def score(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, keep: tuple[str, ...] = ("doc_id",), max_labels: int = MAX_LABELS) -> DataFrame:
    """The columns `keep` (doc_id among them), held_out, score, predicted, n_tokens, n_passages and passages (word
    ranges `start:end`) of every row."""
    known = training_labels(labels, "toxic", max_labels)
    marked = docs.join(F.broadcast(known), "doc_id", "left")
    ratio, z = cell_scores(*count_cells(marked, "__y"))
    found = materialize(segment_rows(marked, "__y", ratio, z, keep), "segments")
    bins = found.where("bin is not null").groupBy("bin").agg(F.sum("bin_words").alias("n")).collect()  # 1,202 rows at most
    centres = np.concatenate([SCORE_EDGES[:1], (SCORE_EDGES[:-1] + SCORE_EDGES[1:]) / 2, SCORE_EDGES[-1:]])
    lam = karlin_lambda(centres[[r["bin"] for r in bins]], np.array([float(r["n"]) for r in bins]))
    ln_n = F.log(F.greatest(F.col("n_tokens"), F.lit(1)))
    bits = F.transform("segments", lambda s: F.lit(lam) * s["score"] - ln_n)
    rows = found.where("bin is null").select(
        *keep,
        "n_tokens",
        F.coalesce(F.array_max(bits), -ln_n - 1.0).alias("best"),
        F.aggregate(F.filter(bits, lambda x: x >= math.log(1 / alpha)), F.lit(0.0), lambda a, x: a + x).alias("sum"),
        F.filter("segments", lambda s: F.lit(lam) * s["score"] - ln_n >= math.log(1 / alpha)).alias("strong"),
    )
    rows = rows.withColumns({"n_passages": F.size("strong").cast("long"), "rest": F.when(F.size("strong") > 0, F.col("sum") - F.col("best")).otherwise(0.0)})
    seen = rows.join(F.broadcast(known), "doc_id")
    # the mean of the Gumbel law is ln K + 0.5772 here
    null = seen.where(F.col("__y") == 0).agg(F.avg("best")).first()[0]
    ln_k = (null if null is not None else 0.0) - 0.5772156649
    stat = F.col("best") - F.lit(ln_k) + F.greatest(F.col("rest") - (F.col("n_passages") - 1) * F.lit(max(ln_k, 0.0)), F.lit(0.0))
    stat = F.least(F.greatest(stat, F.lit(float(EDGES[0]))), F.lit(float(EDGES[-1])))
    width = float(EDGES[1] - EDGES[0])
    bins = seen.groupBy(F.floor((stat - float(EDGES[0])) / width).cast("int").alias("bin"), "__y").count().collect()  # 1,602 rows at most
    n = np.zeros((2, len(EDGES)))
    for r in bins:
        n[r["__y"], r["bin"]] += r["count"]
    a, b = fit_logistic(EDGES + width / 2, n[0], n[1])
    out = rows.select(
        *keep,
        held_out().alias("held_out"),
        (1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * stat)))).alias("score"),
        "n_tokens",
        "n_passages",
        F.array_join(F.transform("strong", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("passages"),
    )
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
