"""Best-fit packing of token sequences, bulk-synchronous.

Documents become ids of a public tokenizer plus an end id; longer ones are cut into full pieces. Pieces of one
length are interchangeable, and so are open sequences with one gap, so both are kept as classes (size, first, number):
at most `capacity` lengths, and gap classes whose number the lengths bound too, whatever the number of rows.

A superstep is one Spark job over the class table, which the shared folder holds between supersteps. Gaps and lengths
are sorted by size, long to short, a gap before a length of its size. In that order a length's best fit, the smallest
gap that holds it and that no longer piece takes, is the last gap that is still open: gaps open brackets, pieces close
them. So one pass over the classes finds the successor of any number of pieces at once; the order settles conflicts,
longer pieces first, lower ranks first. A sequence that got a piece takes more of the same length while they last and
fit, as best fit would have it; gaps shrink; and the sweep is repeated.

New sequences are opened only when the longest piece fits no gap: as many as the pieces above the largest gap need at
least (at most k of more than capacity / (k + 1) share one; and their tokens fill it), where small pieces are left to
fill the rest; else as many as the longest harmonic class needs. About twenty supersteps place everything. The last
step computes ranks and places of all pieces where they are. No step collects pieces or sorts them in one task.

Edge cases: null and empty texts are one piece that holds the end id; repeated rows are packed each on their own;
an empty table gives no rows; ids may be of any type. A task that runs again writes its ranks again as one unit, so
lost executors do no harm.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import join_checked, keep, materialize, tidy

CAPACITY = 2048
END_ID = 0
CACHE_WORDS = 200_000
#: The split that the tokenizer makes, for characters that `WordIds` has proven to class alike in Python.
PRE_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


#: What splits words, of one byte each.
BLANKS = " \t\n\v\f\r"


class WordIds:
    """Ids of whole texts as packed little-endian 32-bit numbers. Nothing is merged across blanks, so ids are kept
    by word, and a new word's by pre-token; the library's merges run on what is new, once while it stays cached."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(tokenizer_file)
        self.safe = {c for c in map(chr, range(0x180)) if self._alike(c) and (not c.isspace() or c in BLANKS)}
        self.unlike = bytes(i for i in range(256) if chr(i) not in self.safe)
        mapped = {ord(c): self.lib.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in self.safe if not c.isascii()}
        self.words = Words(Parts(self.lib, mapped))

    def _alike(self, c: str) -> bool:
        """Python lowers, normalises and splits this character as the library does."""

        def pieces(text):
            return len(self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(text)))

        low = c.lower()
        blank = c.isspace() and re.fullmatch(r"\s", c)
        if len(low) != 1 or unicodedata.normalize("NFC", c) != c or self.lib.normalizer.normalize_str(c) != (" " if blank else low):
            return False
        return all(pieces(t) == len(PRE_TOKENS.findall(t.lower())) for t in (c, c + c, f"a{c}a", f"1{c}1", f"!{c}!", f"a{c}1", f"'{c}"))

    def _plain(self, text: str) -> bool:
        """Python splits and lowers this text as the library does, and it holds no special token."""
        if "<|" in text:
            return False
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return self.safe.issuperset(text)
        return len(raw.translate(None, self.unlike)) == len(raw)

    def packed(self, texts: pa.Array) -> list[bytes]:
        """The words of all plain texts are made one dictionary, whose words are looked up once each."""
        whole = texts.to_pylist()
        plain = [self._plain(t or "") for t in whole]
        split = pc.ascii_split_whitespace(texts.filter(pa.array(plain, pa.bool_())).fill_null(""))
        words = split.flatten().dictionary_encode()
        found = list(map(self.words.__getitem__, words.dictionary.to_numpy(zero_copy_only=False)))
        code, size = words.indices.to_numpy(), np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(size) - size
        length = size[code]
        till = np.concatenate([[0], np.cumsum(length)])
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(first[code] - till[:-1], length) + np.arange(till[-1])]
        ends = till[split.offsets.to_numpy()]
        parts = iter(ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True))
        return [next(parts) if ok else np.asarray(self.lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t, ok in zip(whole, plain, strict=True)]


class Parts(dict):
    """Lower-case pre-tokens to packed ids, by the library's merges; restarts when full."""

    def __init__(self, lib, mapped: dict[int, str]):
        super().__init__()
        self.merge, self.mapped = lib.model.tokenize, mapped  # how the library spells the bytes of other characters

    def __missing__(self, part: str) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        tokens = self.merge(part if part.isascii() else part.translate(self.mapped))
        out = self[part] = array("I", [t.id for t in tokens]).tobytes()
        return out


class Words(dict):
    """Blank-free words to packed ids, through those of their pre-tokens; restarts when full."""

    def __init__(self, parts: Parts):
        super().__init__()
        self.parts = parts

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        low = word.lower()
        out = self[word] = self.parts[low] if low.isalpha() else b"".join(map(self.parts.__getitem__, PRE_TOKENS.findall(low)))
        return out


def word_ids(tokenizer_file: str) -> WordIds:
    """One for each Python worker, so tasks that follow each other share its cache; other operators' tasks drop it."""
    return keep(tokenizer_file, lambda: WordIds(tokenizer_file))


#: Kinds of rows of the state: open gaps, lengths left, the number of sequences so far, and what was placed.
GAP, LEFT, OPENED, PLACED = range(4)
#: first: the first sequence of a gap class, the first rank of a length; seq and offset: where placed ranks stand.
STATE = ("kind", "size", "first", "n", "seq", "offset")
#: Where a sequence holds up to so many of the smallest piece left, one harmonic class after the other gets sequences.
FEW = 5


Class = tuple[int, int, int]  # size, first, n


def to_open(gaps: list[Class], left: list[Class], capacity: int) -> int:
    """How many new sequences the longest piece asks for; none if it fits a gap."""
    top_gap = max((size for size, _, _ in gaps), default=0)
    big = sorted(((size, n) for size, _, n in left if size > top_gap), reverse=True)
    if not big:
        return 0
    if capacity // min(size for size, _, _ in left) <= FEW:
        fit = capacity // big[0][0]
        return -(-sum(n for size, n in big if capacity // size == fit) // fit)
    longer, bounds = 0, [-(-sum(size * n for size, n in big) // capacity)]
    for size, n in big:
        longer += n
        bounds.append(-(-longer // (capacity // size)))
    return max(bounds)


def sweep(gaps: list[Class], left: list[Class]) -> tuple[list[tuple[int, int, int, int, int]], list[Class]]:
    """One sweep over both, long to short: (size, gap, seq, rank, n) of what is matched, and the gaps not taken."""
    events = sorted([(-size, GAP, first, n) for size, first, n in gaps] + [(-size, LEFT, first, n) for size, first, n in left])
    open_, matched = [], []
    for minus, kind, first, n in events:
        if kind == GAP:
            open_.append((-minus, first, n))
            continue
        while n and open_:
            gap, seq, free = open_.pop()
            take = min(n, free)
            matched.append((-minus, gap, seq + free - take, first, take))
            first, n = first + take, n - take
            if take < free:
                open_.append((gap, seq, free - take))
    return matched, open_


def superstep(gaps: list[Class], left: list[Class], opened: int, capacity: int) -> tuple[list[Class], list[Class], int, list[tuple[int, int, int, int, int]]]:
    """Gaps, lengths and the number of sequences after one sweep, and (size, rank, n, seq, offset) of what it placed."""
    more = to_open(gaps, left, capacity)
    matched, rest = sweep([*gaps, (capacity, opened, more)] if more else gaps, left)
    of: dict[int, list] = {}
    for size, gap, seq, rank, n in matched:
        of.setdefault(size, []).append((gap, seq, rank, n))
    placed, still = [], []
    for size, first, n in left:
        parts = sorted(of.get(size, []))
        taken = sum(part[3] for part in parts)
        first, n = first + taken, n - taken
        for gap, seq, rank, width in parts:
            placed.append((size, rank, width, seq, capacity - gap))
            again = min(gap // size - 1, n // width)
            for layer in range(1, again + 1):
                placed.append((size, first, width, seq, capacity - gap + layer * size))
                first, n = first + width, n - width
            if gap > size * (again + 1):
                rest.append((gap - size * (again + 1), seq, width))
        if n:
            still.append((size, first, n))
    return rest, still, opened + more, placed


def _superstep(state: DataFrame, capacity: int) -> DataFrame:
    """The state after one sweep with the rows that it placed: one task, as the classes are few whatever the input."""

    def run(batches):
        rows = [r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)]
        of = lambda kind: [r[1:] for r in rows if r[0] == kind]
        gaps, left, opened, placed = superstep(of(GAP), of(LEFT), of(OPENED)[0][1], capacity)
        out = [(GAP, *g, None, None) for g in gaps] + [(LEFT, *c, None, None) for c in left] + [(OPENED, 0, opened, 0, None, None)] + [(PLACED, *r) for r in placed]
        kinds = (pa.int32(), *(pa.int64(),) * 5)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=list(STATE))

    before = state.where(F.col("kind") < PLACED).select(*STATE[:4]).coalesce(1)
    return materialize(before.mapInArrow(run, "kind int, size long, first long, n long, seq long, offset long"), "state")


def place_classes(lengths: DataFrame, capacity: int) -> DataFrame:
    """size, first (rank among the pieces of that length), n, seq and offset: where all pieces of `lengths` (length,
    n) go, n ranks from `first` on to n sequences from `seq` on."""
    row = lambda kind, size, first, n: (F.lit(kind).alias("kind"), *(v.cast("long").alias(c) for v, c in zip((size, first, n, F.lit(None), F.lit(None)), STATE[1:], strict=True)))
    zero = F.lit(0)
    start = lengths.sparkSession.range(1).select(*row(OPENED, zero, zero, zero))
    state = materialize(lengths.where("n > 0").select(*row(LEFT, F.col("length"), zero, F.col("n"))).unionByName(start).coalesce(1), "state")
    steps = [state._sumi_path]
    while not state.where(F.col("kind") == LEFT).isEmpty():
        state = _superstep(state, capacity)
        steps.append(state._sumi_path)
    every = state.sparkSession.read.schema(state.schema).parquet(*steps)
    return every.where(F.col("kind") == PLACED).select("size", "first", "n", "seq", "offset")


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, with its chunk and its rank by length there."""
    end = int(end_id).to_bytes(4, "little")
    rows = docs.select("doc_id", "text")
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())

    def run(batches):
        from pyspark import TaskContext

        chunk, ids, seen = TaskContext.get().partitionId(), word_ids(tokenizer_file), {}
        for batch in batches:
            found, owner = [], []
            for i, packed in enumerate(ids.packed(batch.column(1))):
                packed += end
                for start in range(0, len(packed), 4 * capacity):
                    part = packed[start : start + 4 * capacity]
                    n = len(part) // 4
                    rank = seen[n] = seen.get(n, -1) + 1
                    owner.append(i)
                    found.append((start // (4 * capacity), start // 4, n, zlib.crc32(part), chunk, rank))
            columns = list(zip(*found, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "rank"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run, tokenizer_file), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, chunk int, rank long")


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece with its sequence_id and its offset there."""
    cut = materialize(pieces(docs, tokenizer_file, capacity, end_id), "pieces")
    by_chunk = materialize(cut.groupBy("chunk", "length").agg(F.count("*").alias("n")), "piece-counts", narrow=True)
    placed = place_classes(by_chunk.groupBy("length").agg(F.sum("n").alias("n")), capacity)
    # classes of placed ranks: their number depends on the lengths, not on the number of pieces
    table = placed.orderBy("size", "first").toArrow()
    sizes, starts, firsts, offsets = (table[c].to_numpy() for c in ("size", "first", "seq", "offset"))
    stride = int((starts + table["n"].to_numpy()).max()) if len(starts) else 1
    starts = sizes * stride + starts  # ranks of all lengths in one order
    before = F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    moved = materialize(by_chunk.select("chunk", "length", F.coalesce(before, F.lit(0)).alias("before")), "ranks-before", narrow=True)
    ranked = join_checked(cut, moved, ["chunk", "length"], "inner").select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = length * stride + rank
            k = np.searchsorted(starts, at, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(5)), pa.array(firsts[k] + at - starts[k]), pa.array(offsets[k])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = cut.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
