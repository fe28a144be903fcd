"""Token counts and packing against the libraries."""

import bisect
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sumi.llm.packing import WordIds, pack, place_classes, superstep
from sumi.llm.token_counts import UnitCounter, count_tokens

MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
HARD = ["", " ", "  ", "a ", " a", "a  b", "a\nb", "\n", "\n\na", "a \n b", "a\n b ", "x<s>y </s>", "日本 \t tab", " \n", "a\r\nb", "▁x y", "1½2 a_b __ !'s 'S I'M", "ǅ İ a\x1cb", "<|endoftext|> x", "ΣΣ á"]


def test_counts_match_library(docs, odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for frame in (docs, odd):
        texts = sorted((r.text or "") for r in frame.select("text").collect())
        want = sorted((len(t.encode()), len(sp.encode(t))) for t in texts)
        got = sorted((r.n_bytes, r.n_tokens) for r in count_tokens(frame, MODEL).collect())
        assert got == want


def test_units_of_hard_texts():
    counter = UnitCounter(MODEL)
    assert counter.splits
    assert counter.counts(HARD) == [len(x) for x in counter.model.encode(HARD)]


def test_counts_of_nothing(none):
    assert count_tokens(none, MODEL).count() == 0


def test_word_ids_of_hard_texts():
    lib, ids = Tokenizer.from_file(WORDS), WordIds(WORDS)
    for text in HARD:
        want = np.asarray(lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert ids.packed(pa.array([text]))[0] == want, text
    assert ids.packed(pa.array(HARD)) == [ids.packed(pa.array([t]))[0] for t in HARD]
    assert ids.packed(pa.array([None, ""], pa.string())) == [b"", b""] and ids.packed(pa.array([], pa.string())) == []


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pack_is_whole(odd, docs, capacity):
    lib = Tokenizer.from_file(WORDS)
    for frame in (odd, docs):
        rows = pack(frame, WORDS, capacity).collect()
        want = []
        for r in frame.select("doc_id", "text").collect():
            ids = np.asarray([*lib.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
            for start in range(0, len(ids), capacity):
                part = ids[start : start + capacity]
                want.append((r.doc_id, start // capacity, start, len(part), zlib.crc32(part.tobytes())))
        key = lambda x: tuple(-1 if v is None else v for v in x)
        assert sorted((tuple(r[:5]) for r in rows), key=key) == sorted(want, key=key)
        places = defaultdict(list)
        for r in rows:
            places[r.sequence_id].append((r.offset, r.length))
        for found in places.values():
            at = 0
            for offset, length in sorted(found):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(places) <= 1.01 * best_fit(Counter(r.length for r in rows), capacity)


def test_pack_of_nothing(none):
    assert pack(none, WORDS).count() == 0


def best_fit(counts, capacity):
    """The number of sequences by sequential best fit, piece by piece, long to short."""
    gaps, opened = [], 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            at = bisect.bisect_left(gaps, length)
            gap = gaps.pop(at) if at < len(gaps) else capacity
            opened += gap == capacity
            if gap > length:
                bisect.insort(gaps, gap - length)
    return opened


def lengths_of(kind, rng):
    return {
        "any": lambda: rng.integers(1, 257, 3000),
        "long": lambda: rng.integers(100, 257, 900),
        "middle": lambda: rng.integers(50, 140, 1500),
        "short": lambda: rng.integers(1, 30, 4000),
        "skewed": lambda: np.minimum(256, rng.lognormal(3.5, 1.2, 4000).astype(int) + 1),
        "one": lambda: np.full(700, 87),
        "few": lambda: rng.integers(1, 257, 7),
    }[kind]()


@pytest.mark.parametrize("kind", ["any", "long", "middle", "short", "skewed", "one", "few"])
def test_supersteps_pack_like_sequential_best_fit(spark, kind):
    """Every rank has one place, nothing overlaps or leaves a hole, and hardly a sequence more is opened."""
    counts = Counter(lengths_of(kind, np.random.default_rng(1)).tolist())
    frame = spark.createDataFrame(sorted(counts.items()), "length long, n long")
    rows = place_classes(frame, 256).collect()
    ranks, places = defaultdict(list), defaultdict(list)
    for r in rows:
        for k in range(r.n):
            ranks[r.size].append(r.first + k)
            places[r.seq + k].append((r.offset, r.size))
    assert {size: sorted(found) for size, found in ranks.items()} == {size: list(range(n)) for size, n in counts.items()}
    for found in places.values():
        at = 0
        for offset, size in sorted(found):
            assert offset == at
            at += size
        assert at <= 256
    assert len(places) <= 1.01 * best_fit(counts, 256) + 1
    if kind in ("any", "long", "short", "one", "few"):
        assert len(places) <= best_fit(counts, 256)


@pytest.mark.parametrize("seed", range(30))
def test_supersteps_against_sequential_best_fit(seed):
    """Many random tables, without Spark."""
    rng = np.random.default_rng(seed)
    low, high = sorted(rng.integers(1, 2049, 2).tolist())
    counts = Counter(rng.integers(low, high + 1, int(rng.integers(1, 5000))).tolist())
    gaps, left, opened, total = [], [(size, 0, n) for size, n in counts.items()], 0, 0
    for _ in range(5000):
        if not left:
            break
        gaps, left, opened, placed = superstep(gaps, left, opened, 2048)
        total += sum(n for _, _, n, _, _ in placed)
    assert total == sum(counts.values())
    assert opened <= 1.02 * best_fit(counts, 2048) + 1


def test_ids_of_any_kind(spark):
    frame = spark.createDataFrame([("a", "some words"), (None, None), ("b", "x " * 3000)], "doc_id string, text string")
    assert sorted((r.doc_id or "", r.piece) for r in pack(frame, WORDS).collect()) == [("", 0), ("a", 0), ("b", 0), ("b", 1)]
