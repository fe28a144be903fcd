"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases (LZ78 over code points: each phrase is the shortest string that is not in
the dictionary yet). The phrase set, hashed by a polynomial over code points, is summed up by minimum hashes; the
share of equal minima estimates the phrase sets' Jaccard similarity, so texts that compress alike score high. The
dictionary holds all prefixes of its phrases, so a text that shares a beginning with another is parsed on from there.

`compare_next` gives each document's fingerprint, that of an edited text (its last third replaced by the beginning
of the next document in descending id order) and both likenesses. Documents are range-partitioned by id once; a
task streams its sorted rows and looks one row ahead; only each task's first and last row meet again in a small join.

Edge cases: null and empty texts have an empty phrase set, like each other (1) and nothing else (0); null ids come
last; equal ids are ordered by a hash of their text; one document is its own next; repeated rows are rows of their own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import materialize

MINIMA = 128
SEED = 11
BASE = 0x9E3779B97F4A7C15 | 1


class Phrases:
    """Parses and fingerprints texts; one for each task."""

    def __init__(self, minima: int = MINIMA, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mul = rng.integers(1, 1 << 32, minima, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.add = rng.integers(0, 1 << 32, minima, dtype=np.uint64).astype(np.uint32)
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            size = max(n, 2 * len(self.power), 4096)
            for name, base in (("power", BASE), ("inverse", pow(BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    @staticmethod
    def parse(text: str, known: set[str], start: int, ends: list[int]) -> None:
        """Append the ends of the phrases from `start` on; `known` is the dictionary so far."""
        i, n = start, len(text)
        while i < n:
            j = i + 3
            if text[i:j] in known and j <= n:
                j += 1
                while text[i:j] in known and j <= n:
                    j += 1
            elif text[i : i + 2] in known:
                pass
            elif text[i : i + 1] in known:
                j = i + 2
            else:
                j = i + 1
            known.add(text[i:j])
            i = min(j, n)
            ends.append(i)

    def minima(self, text: str, ends: list[int]) -> np.ndarray:
        """The signature of the phrases that end there, 16 bits for each hash."""
        if not ends:
            return np.full(len(self.mul), 0xFFFF, np.uint16)
        n = len(text)
        self._powers(n + 1)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * self.power[:n], out=sums[1:])
        end = np.asarray(ends)
        start = np.concatenate([[0], end[:-1]])
        h = (sums[end] - sums[start]) * self.inverse[start]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h = np.unique((h >> np.uint64(32)).astype(np.uint32))
        out = np.full(len(self.mul), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(h), 4096):
            part = h[at : at + 4096] * self.mul[:, None] + self.add[:, None]
            # the top bits of a product depend on all of the hash, the low ones do not
            np.minimum(out, part.min(axis=1), out=out)
        return (out * np.uint32(0x85EBCA6B) >> np.uint32(16)).astype(np.uint16)

    def of(self, text: str) -> tuple[np.ndarray, list[int]]:
        ends: list[int] = []
        self.parse(text, set(), 0, ends)
        return self.minima(text, ends), ends

    def edited(self, text: str, ends: list[int], following: str) -> tuple[str, np.ndarray]:
        """The text with its last third replaced by the beginning of `following`, and its signature."""
        n = len(text)
        cut = n - n // 3
        new = text[:cut] + following[: n // 3]
        k = int(np.searchsorted(ends, cut, side="right"))
        kept = ends[:k]
        known = {text[a:b] for a, b in zip([0, *kept], kept, strict=False)}
        self.parse(new, known, kept[-1] if kept else 0, kept)
        return new, self.minima(new, kept)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def packed(signature: np.ndarray) -> bytes:
    return signature.astype(">u2").tobytes()


RESULT = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
DIGESTS = ("edited_sha256", "fingerprint", "edited_fingerprint")  # bytes until the end, which is half of what their text takes
ARROW = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())


def _finish(phrases: Phrases, text: str, signature: np.ndarray, ends: list[int], next_text: str, next_signature: np.ndarray) -> tuple:
    new, changed = phrases.edited(text, ends, next_text)
    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).digest()
    return len(text), digest, packed(signature), packed(changed), likeness(signature, changed), likeness(signature, next_signature)


def compare_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").asc()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    names = ["doc_id", *RESULT, "part", "place", "text"]
    kinds = (pa.int64(), *ARROW, pa.int32(), pa.string(), pa.string())

    def run(batches):
        from pyspark import TaskContext

        part, phrases, last = TaskContext.get().partitionId(), Phrases(), None
        empty = (None,) * len(RESULT)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                signature, ends = phrases.of(text)
                if last is None:
                    out.append((doc_id, *empty, part, "first", text))
                else:
                    out.append((last[0], *_finish(phrases, *last[1:], text, signature), part, None, None))
                last = (doc_id, text, signature, ends)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names=names)
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((last[0], *empty, part, "last", last[1]), kinds, strict=True)], names=names)

    done = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    streamed = materialize(rows.mapInArrow(run, f"{done}, part int, place string, text string"), "fingerprints")
    # a row for each task and end
    ends = streamed.where("place is not null").select("doc_id", "part", "place", "text")
    firsts = ends.where("place = 'first'").select("part", F.col("text").alias("next_text"))
    by_part = Window.orderBy("part")
    following = firsts.select("part").select(F.col("part"), F.coalesce(F.lead("part").over(by_part), F.min("part").over(Window.partitionBy())).alias("next_part"))
    pairs = ends.where("place = 'last'").join(following, "part").join(firsts.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "text", "next_text")

    def close(batches):
        phrases = Phrases()
        for batch in batches:
            out = []
            for doc_id, text, next_text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                signature, at = phrases.of(text)
                out.append((doc_id, *_finish(phrases, text, signature, at, next_text, phrases.of(next_text)[0])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds[:7], strict=True)], names=names[:7])

    whole = streamed.where("place is null").select(*names[:7])
    done_rows = whole.unionByName(pairs.mapInArrow(close, done))
    return done_rows.withColumns({c: F.lower(F.hex(c)) for c in DIGESTS})
