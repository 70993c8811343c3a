"""Benchmark decontamination by suffix arrays of the training texts.

Each task lays the words of its documents out as one array of word ids, a shard,
and sorts the shard's suffixes by their first words. Every suffix of every
benchmark item is then binary-searched in the shard's suffix array: the range
found holds all places where the item's window occurs. Runs of windows along a
diagonal give the longest verbatim matches and where they are.

A suffix whose first words are not all words of the benchmark cannot match, so it
is left out of the array; the result is that of the whole array. Benchmark items
travel in blocks of a bounded number of words, one broadcast each, and every
shard is searched for every block.

Null text has no words: no hits, the digest of the empty list. Items with a null
id cannot be named and are left out; items that repeat an id count once. Rows are
never joined or grouped, so repeated rows and null ids come back as they are. An
empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekernel import ALNUM, buffers, hashes, spans
from .common import text_batches

RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_words long, longest_start long, longest_item long"


@dataclass
class QueryBlock:
    """Windows of benchmark items as word ids; id 0 is no benchmark word."""

    vocabulary: np.ndarray  # sorted word hashes; the id of a word is its place + 1
    maybe: np.ndarray  # by the low 16 bits of a hash: may it be in the vocabulary?
    width: int  # words in a window
    keys: np.ndarray  # distinct windows, big-endian ids, shorter ones filled with 0
    lengths: np.ndarray  # words of each distinct window
    shortest: int
    use_key: np.ndarray  # windows by distinct window: which
    use_item: np.ndarray
    use_place: np.ndarray  # place of the window in the concatenated items

    @classmethod
    def build(cls, items: list[tuple[int, np.ndarray]], width: int) -> QueryBlock:
        vocabulary = np.unique(np.concatenate([w for _, w in items]))
        maybe = np.zeros(1 << 16, bool)
        maybe[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        rows, lengths, item, place, at = [], [], [], [], 0
        for item_id, words in items:
            ids = np.searchsorted(vocabulary, words).astype(np.int64) + 1
            n = min(width, len(ids))
            for p in range(len(ids) - n + 1):
                row = np.zeros(width, ">u4")
                row[:n] = ids[p : p + n]
                rows.append(row.tobytes())
                lengths.append(n)
                item.append(item_id)
                place.append(at + p)
            at += len(ids) + 1
        keys, inverse = np.unique(np.array(rows, f"S{4 * width}"), return_inverse=True)
        length_of = np.zeros(len(keys), np.int64)
        length_of[inverse] = lengths
        order = np.argsort(inverse, kind="stable")
        return cls(vocabulary, maybe, width, keys, length_of, int(min(lengths)), inverse[order], np.array(item, np.int64)[order], np.array(place, np.int64)[order])

    def ids(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        some = np.flatnonzero(self.maybe[(words & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, words[some])
        at[at == len(self.vocabulary)] = 0
        hit = self.vocabulary[at] == words[some]
        out[some[hit]] = at[hit] + 1
        return out


class SuffixArray:
    """Places of a shard, sorted by the window of word ids that starts there."""

    def __init__(self, ids: np.ndarray, firsts: np.ndarray, width: int, shortest: int):
        n = len(ids)
        # words left until the next word outside the benchmark or the document's end
        stop = np.flatnonzero(ids == 0)
        ends = np.full(n, n, np.int64)
        if n:
            at = np.searchsorted(stop, np.arange(n))
            ends = np.append(stop, n)[at]
            ends = np.minimum(ends, np.append(firsts, n)[np.searchsorted(firsts, np.arange(n), side="right")])
        left = ends - np.arange(n)
        places = np.flatnonzero(left >= shortest) if n else np.zeros(0, np.int64)
        grid = np.zeros((len(places), width), ">u4")
        padded = np.append(ids, np.zeros(width, np.int64))
        for j in range(width):
            grid[:, j] = np.where(left[places] > j, padded[places + j], 0)
        keys = grid.reshape(-1).view(f"S{4 * width}") if len(places) else np.zeros(0, f"S{4 * width}")
        order = np.argsort(keys, kind="stable")
        self.places, self.keys = places[order], keys[order]

    def find(self, block: QueryBlock) -> tuple[np.ndarray, np.ndarray]:
        """By distinct window of the block: the range of the array that starts with it."""
        lo = np.searchsorted(self.keys, block.keys, side="left")
        hi = np.searchsorted(self.keys, block.keys, side="right")
        for k in np.flatnonzero(block.lengths < block.width):
            stem = bytes(block.keys[k]).ljust(4 * block.width, b"\0")[: 4 * int(block.lengths[k])]
            hi[k] = np.searchsorted(self.keys, np.array(stem + b"\xff" * (4 * block.width - len(stem)), self.keys.dtype), side="right")
        return lo, hi


def _many_ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and the index in it, for all indices of all ranges."""
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def search(texts: pa.Array, blocks: list) -> dict[str, list]:
    """RESULT's columns for each text. blocks: broadcasts of QueryBlock."""
    data, offsets = buffers(texts)
    starts, ends, firsts = spans(data, offsets, ALNUM)
    words = hashes(data, starts, ends)
    docs = len(texts)
    hit = np.zeros(len(words) + 1, np.int64)
    items: list[set[int]] = [set() for _ in range(docs)]
    longest = [(0, 0, 0)] * docs
    doc_of = np.repeat(np.arange(docs), np.diff(firsts))
    for b in blocks:
        block = b.value
        array = SuffixArray(block.ids(words), firsts[:-1], block.width, block.shortest)
        lo, hi = array.find(block)
        found = np.flatnonzero(hi > lo)
        if not len(found):
            continue
        which, at = _many_ranges(lo[found], hi[found])
        key, place = found[which], array.places[at]
        np.add.at(hit, place, 1)
        np.add.at(hit, place + block.lengths[key], -1)
        # each use of a window by an item, at each place
        u_lo, u_hi = np.searchsorted(block.use_key, key), np.searchsorted(block.use_key, key, side="right")
        pair, use = _many_ranges(u_lo, u_hi)
        d_place, item, q_place, size = place[pair], block.use_item[use], block.use_place[use], block.lengths[key[pair]]
        doc = doc_of[d_place]
        for d, i in np.unique(np.stack([doc, item], axis=1), axis=0).tolist():
            items[d].add(i)
        order = np.lexsort((d_place, d_place - q_place))
        dp, dg, dc = d_place[order], (d_place - q_place)[order], doc[order]
        new = np.ones(len(dp), bool)
        new[1:] = (dg[1:] != dg[:-1]) | (dp[1:] != dp[:-1] + 1) | (dc[1:] != dc[:-1])
        run = np.cumsum(new) - 1
        first, length = np.flatnonzero(new), np.bincount(run) - 1 + size[order][new]
        for k in np.lexsort((item[order][first], dp[first], -length)).tolist():
            d = int(dc[first[k]])
            best = (int(length[k]), int(dp[first[k]] - firsts[d]), int(item[order][first[k]]))
            if best[0] > longest[d][0]:
                longest[d] = best
    covered = np.concatenate([[0], np.cumsum(np.cumsum(hit[:-1]) > 0)])
    n_hit = covered[firsts[1:]] - covered[firsts[:-1]]
    return {
        "n_words": np.diff(firsts).tolist(), "n_hit": n_hit.tolist(), "n_items": [len(x) for x in items],
        "items_sha256": [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in items],
        "contaminated": (n_hit > 0).tolist(), "longest_words": [x[0] for x in longest],
        "longest_start": [x[1] if x[0] else None for x in longest], "longest_item": [x[2] if x[0] else None for x in longest],
    }


def query_blocks(benchmark: DataFrame, width: int, block_words: int, text: str, id_col: str) -> Iterator[QueryBlock]:
    """The benchmark in blocks of about block_words words, one partition at a time on the driver."""
    rows, n = [], 0
    for row in benchmark.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).where("i is not null").distinct().toLocalIterator():
        data, offsets = buffers(pa.array([row["t"]], pa.large_string()))
        starts, ends, _ = spans(data, offsets, ALNUM)
        if not len(starts):
            continue
        rows.append((row["i"], hashes(data, starts, ends)))
        n += len(starts)
        if n >= block_words:
            yield QueryBlock.build(rows, width)
            rows, n = [], 0
    if rows:
        yield QueryBlock.build(rows, width)


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id", block_words: int = 1_000_000) -> DataFrame:
    """id and RESULT for every row of docs. longest_*: the longest run of words that
    an item shares verbatim, its first word's place and the item (of equal ones the first)."""
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(b) for b in query_blocks(benchmark, width, block_words, item_text, item_id)]
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "t", 1 << 20):
            found = search(texts, blocks)
            columns = [pa.array(found[c], t) for c, t in (("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("longest_words", pa.int64()), ("longest_start", pa.int64()), ("longest_item", pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, *found])

    return docs.select(F.col(id_col), F.col(text).alias("t")).mapInArrow(run, f"`{id_col}` {kind}, {RESULT}")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text", item_text: str = "text", item_id: str = "item_id", block_words: int = 1_000_000) -> DataFrame:
    """The rows of docs without a hit, whole and in one pass over docs: the search
    runs where the rows are, and nothing is joined or shuffled."""
    sc = docs.sparkSession.sparkContext
    blocks = [sc.broadcast(b) for b in query_blocks(benchmark, width, block_words, item_text, item_id)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, text, 1 << 20):
            clean = [not x for x in search(texts, blocks)["contaminated"]]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
