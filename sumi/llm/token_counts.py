"""Token counts by the whole-token shortcut.

A SentencePiece BPE model merges inside units only: when no vocabulary string has a space mark after another
character, nothing is ever merged across the start of a run of space marks, and when no string of several
characters holds a line feed, nothing is merged across one. Both facts are proven from the vocabulary when the
model is loaded. A text then splits into units whose counts add up. Vocabulary strings that encode alone as one
token (also proven at load) are counted by one dictionary hit; the library merges the rest, each distinct unit
once while it stays in a cache of bounded size. If a proof fails, every text is encoded whole.

Edge cases: null and empty texts have 0 tokens; runs of spaces take a slower exact path; special strings such as
``<s>`` inside a text are ordinary text, the library's default. Repeated rows give repeated rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize

#: Units kept in a worker's cache; beyond it the cache restarts from the proven whole tokens.
CACHE_UNITS = 200_000
CHUNK_TEXTS = 200
SPACES = re.compile(" +[^ ]*")


class UnitCounter:
    """Counts the tokens of texts with one SentencePiece model."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        spec = proto.ModelProto()
        spec.ParseFromString(self.model.serialized_model_proto())
        pieces = [p.piece for p in spec.pieces]
        norm = spec.normalizer_spec
        self.splits = (
            spec.trainer_spec.model_type == 2
            and norm.name == "identity"
            and not norm.precompiled_charsmap
            and norm.add_dummy_prefix
            and norm.escape_whitespaces
            and not norm.remove_extra_whitespaces
            and not spec.trainer_spec.treat_whitespace_as_suffix
            and all(p.type != 4 for p in spec.pieces)
            and not any(re.search("[^▁]▁", p) or ("\n" in p and len(p) > 1) for p in pieces)
        )
        words = [p[1:] for p in pieces if p[0] == "▁" and len(p) > 1 and "▁" not in p[1:]]
        self.whole = {w: 1 for w, ids in zip(words, self.model.encode(words, num_threads=1), strict=True) if len(ids) == 1}
        self.lone = len(self.model.encode("x ", num_threads=1)) - len(self.model.encode("x", num_threads=1))
        self.whole[""] = self.lone
        self.cache = dict(self.whole)

    def units(self, text: str) -> list[str]:
        """A unit that begins with a line feed has no space mark before it; any other one has."""
        return text.replace("\n", " \n").split(" ")

    def spaced(self, text: str) -> int:
        parts = [u[1:] for u in SPACES.findall(" " + text)]
        return sum(len(ids) if u else self.lone for u, ids in zip(parts, self.model.encode(parts, num_threads=1), strict=True))

    def counts(self, texts: list[str | None]) -> list[int]:
        if not self.splits:
            return [len(ids) for ids in self.model.encode([t or "" for t in texts], num_threads=1)]
        out = []
        for at in range(0, len(texts), CHUNK_TEXTS):
            some = texts[at : at + CHUNK_TEXTS]
            split = [self.units(t) if t and t[0] != " " and "  " not in t else None for t in some]
            missing = list(set().union(*(u for u in split if u)) - self.cache.keys())
            if missing:
                if len(self.cache) + len(missing) > CACHE_UNITS:
                    # what this chunk already had in the cache is looked up again
                    self.cache = dict(self.whole)
                    missing = list(set().union(*(u for u in split if u)) - self.cache.keys())
                for unit, ids in zip(missing, self.model.encode(missing, num_threads=1), strict=True):
                    self.cache[unit] = len(ids) - self.lone if unit[0] == "\n" else len(ids)
            get = self.cache.__getitem__
            out += [sum(map(get, u)) if u else self.spaced(t) if t else 0 for u, t in zip(split, some, strict=True)]
        return out


_loaded: dict[str, UnitCounter] = {}


def unit_counter(model_file: str) -> UnitCounter:
    """One for each Python worker, so the proofs run once there and tasks that follow each other share its cache."""
    if model_file not in _loaded:
        _loaded[model_file] = UnitCounter(model_file)
    return _loaded[model_file]


def count_tokens(docs: DataFrame, model_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, n_bytes (UTF-8) and n_tokens of every whole text. One pass, no shuffle."""
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", n_bytes long, n_tokens long"

    def run(batches):
        counter = unit_counter(model_file)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            n_bytes = pc.binary_length(texts).cast(pa.int64())
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [n_bytes, pa.array(counter.counts(texts.to_pylist()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_bytes", "n_tokens"])

    return materialize(rows.mapInArrow(run, schema), "token-counts")
