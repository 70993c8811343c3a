"""Token counts of whole texts, by batch encoding inside Arrow functions.

A text is cut at safe boundaries only: before a single space between two
characters that are not white space. Byte-level BPE always starts a new pre-token
there (`` ?\\p{L}+`` and its siblings take the space with what follows, no added
token holds a space), so the pieces' counts add up to the text's. Batches hold
about as many bytes each; a piece is encoded at most once per batch, and only
its length is kept, of the pieces met last in a worker.

Null text counts as empty (0 bytes, 0 tokens). Rows are never joined or grouped,
so repeated rows, ties and null ids come back as they are.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lazily, text_batches

#: A space where a text may be cut without changing its tokens.
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Characters of a piece whose count is kept, and of the pieces encoded at once.
_LONGEST, _PART = 64, 1 << 16


class PieceCounter:
    """Counts tokens of texts with a `tokenizers` byte-level tokenizer. What it keeps is
    bounded: counts of at most 2 * keep pieces of at most _LONGEST characters."""

    def __init__(self, path: str, keep: int = 120_000):
        from tokenizers import Tokenizer

        self._encoder = Tokenizer.from_file(path)
        self._encoder.no_truncation()
        self._encoder.no_padding()
        self._known: dict[str, int] = {}
        self._older: dict[str, int] = {}
        self._keep = keep

    def lengths(self, pieces: list[str]) -> list[int]:
        # the same tokens as encode_batch, without their offsets
        return [len(e) for e in self._encoder.encode_batch_fast(pieces, add_special_tokens=False)]

    def _encoded(self, pieces: list[str]) -> Iterator[tuple[str, int]]:
        """Pieces with their lengths, encoded in parts of about _PART characters."""
        lo = n = 0
        for i, w in enumerate(pieces):
            if i - lo == 512 or n and n + len(w) > _PART:
                yield from zip(pieces[lo:i], self.lengths(pieces[lo:i]))
                lo, n = i, 0
            n += len(w)
        yield from zip(pieces[lo:], self.lengths(pieces[lo:]))

    def counts(self, texts: list[str]) -> list[int]:
        split = [_SAFE.split(t) for t in texts]
        # a piece after a cut starts with the space that the cut took
        pieces = {p[0] for p in split}
        rest = {w for p in split for w in p[1:]}
        pieces.update(" " + w for w in rest)
        now, new = {}, []
        for w in pieces:
            if (n := self._known.get(w)) is None and (n := self._older.get(w)) is None:
                new.append(w)
            else:
                now[w] = n
        now.update(self._encoded(new))
        for w, n in now.items():
            if len(w) <= _LONGEST:
                if len(self._known) >= self._keep:
                    self._known, self._older = {}, self._known
                self._known[w] = n
        later = {w: now[" " + w] for w in rest}
        return [now[p[0]] + sum(map(later.__getitem__, p[1:])) if p[0] or len(p) > 1 else 0 for p in split]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, text: str = "text", id_col: str = "doc_id", batch_bytes: int = 1 << 19) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) for every row.

    tokenizer_path: a tokenizer file of the `tokenizers` library that every
    executor can open (part of its environment, as the library itself is).
    """
    kind = docs.schema[id_col].dataType

    def make() -> PieceCounter:
        # tasks are parallel already; threads cost memory of their own in each worker
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return PieceCounter(tokenizer_path)

    get = lazily(make)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = get()
        for batch, texts in text_batches(batches, "t", batch_bytes):
            n = counter.counts(texts.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )
            pa.default_memory_pool().release_unused()

    slim = docs.select(F.col(id_col), F.col(text).alias("t"))
    return slim.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
