"""N-gram Jaccard join by signature trees.

A document's set holds the hashes of its distinct word shingles. Three steps:

1. Blocks. Equal sets become one node. Sets of a size class are dealt, shingle by
   shingle, into more parts than a pair over the threshold can differ in; such a
   pair agrees on a whole part (pigeonhole), one of the best few by what they hold,
   and whole parts are what nodes are grouped by. Documents
   of one group are chained to its smallest (never paired with each other), and the
   components of those chains are the blocks. No linked pair lies in two blocks.
2. Signature trees. In each block the nodes are leaves of a tree in which every
   inner node holds the OR of its leaves' token bitmaps, the range of their sizes
   and the largest excess of tokens over bits. Dual traversal compares the tree with
   itself and drops a pair of tree nodes when the largest overlap they can have is
   below what the threshold needs at their smallest sizes, or when all their leaves
   are in one component already. Leaf pairs that remain are verified on whole sets.
   A block of more than a bounded number of shingles is cut into sub-blocks, and
   each pair of them is a task of its own.
3. Components of the verified links.

Documents without words (null, empty) have empty sets and are linked with nothing.
Each row takes the class of its own set, so repeated rows come back as often as they
are there. Rows with a null id take the class of an equal set and have none (null)
where no row with an id holds it. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekernel import NONSPACE, buffers, hashes, mix, shingles, spans
from .common import connected_components, id_filter, materialise, partitions, stream_groups, temporary, text_batches, without

#: Ratio of the sizes at a size class's ends.
_CLASS = 1.6
#: Shingles in a (sub-)block.
_BLOCK_SHINGLES = 3_000_000
#: Bytes of texts whose words are hashed at once.
_AT_ONCE = 1 << 18
_FANOUT = 16


def document_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Words are hashed for about _AT_ONCE
    bytes of texts at a time (at least one text), as hashing takes many times their memory."""
    data, offsets = buffers(texts)
    out, lo = [], 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _AT_ONCE, side="right")) - 1)
        own = data[offsets[lo] : offsets[hi]]
        starts, ends, firsts = spans(own, offsets[lo : hi + 1] - offsets[lo], NONSPACE)
        words = hashes(own, starts, ends)
        out += [np.unique(shingles(words[a:b], k)) for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist())]
        lo = hi
    return out


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _class_bounds(c: int) -> tuple[int, int]:
    return math.ceil(_CLASS**c), math.ceil(_CLASS ** (c + 1)) - 1


def _class_of(n: int) -> int:
    c = int(math.log(n) / math.log(_CLASS))
    while _class_bounds(c)[0] > n:
        c -= 1
    while _class_bounds(c)[1] < n:
        c += 1
    return c


def part_signatures(s: np.ndarray, percent: int, common: np.ndarray | None = None) -> np.ndarray:
    """Hashes of parts of a set, for its size class and, where a partner may be
    there, for the next one.

    Distinct sets with 100 * |A & B| >= percent * |A | B| have
    |A ^ B| <= d = min(|A|, |B|) * (100 - percent) / percent, and each part on which
    they differ takes one of these. So with more than d filled parts a set agrees
    with its partner on a filled one. Parts are ranked by what they hold: those with
    most shingles that are not common come first. Before the best part on which two
    sets agree only parts can come on which they differ, d at most; so the best
    d + 1 are enough, and passages that many documents share tie nothing. The few
    sets with no more than d filled parts name all, the empty ones too: two of them
    agree on a part, filled or empty, as there are over d parts.
    """
    n, out = len(s), []
    d = n * (100 - percent) // percent
    if not d:
        return np.zeros(0, np.uint64)  # only equal sets could link, and those are one node
    c = _class_of(n)
    top = _class_bounds(c)[1]
    rare = np.ones(n, np.int64) if common is None or not len(common) else (common[np.minimum(np.searchsorted(common, s), len(common) - 1)] != s).astype(np.int64)
    labels = [c] + [c + 1] * (n * 100 >= percent * (top + 1))
    for label in labels:
        parts = int(_class_bounds(label)[1] * (100 - percent) / percent * 1.3) + 3
        m = mix(s + np.uint64(label * 2 + 1))
        part = ((m >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        filled, first = np.unique(part[order], return_index=True)
        name = lambda p: mix(p.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(label + 1))
        own = mix(np.add.reduceat(m[order], first) ^ name(filled))
        if len(filled) > d:
            best = np.lexsort((own, -np.add.reduceat(rare[order], first)))
            out.append(own[best[: d + 1]])
        else:
            empty = np.setdiff1d(np.arange(parts), filled, assume_unique=True)
            out += [own, mix(np.uint64(0x5851F42D4C957F2D) ^ name(empty))]
    return np.concatenate(out)


def common_shingles(docs: DataFrame, k: int, text: str, least: int = 3, most: int = 1 << 20) -> np.ndarray:
    """Sorted hashes of shingles that many documents hold: counted where `least`
    texts of one batch of about 2 MB do, added up, the commonest ones (at most
    `most`, 8 MB). They only rank parts; no result depends on which they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_batches(batches, "t", 2 << 20):
            h = np.sort(np.concatenate(document_sets(texts, k)))
            if not len(h):
                continue
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            times = np.diff(np.append(first, len(h)))
            some = times >= least
            yield pa.RecordBatch.from_arrays([pa.array(h[first][some].view(np.int64)), pa.array(times[some])], names=["h", "n"])

    counts = materialise(docs.select(F.col(text).alias("t")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "common")
    floor = least
    while counts.where(F.col("n") >= floor).count() > most:
        floor *= 2
    return np.sort(counts.where(F.col("n") >= floor).toPandas()["h"].to_numpy(np.int64).view(np.uint64))


class SignatureTree:
    """Sets as leaves in a given order, with bitmaps OR-ed upwards."""

    def __init__(self, sets: list[np.ndarray]):
        # by the mean and not the largest size: one large set must not widen all bitmaps; tokens that share a bit count as excess
        bits = max(256, 1 << math.ceil(math.log2(4 * sum(map(len, sets)) / len(sets))))
        maps = np.zeros((len(sets), bits // 8), np.uint8)
        for i, s in enumerate(sets):
            at = (s & np.uint64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(maps[i], at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
        maps = maps.view(np.uint64)
        sizes = np.array([len(s) for s in sets], np.int64)
        excess = sizes - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels = [(maps, sizes, sizes, excess)]
        while len(self.levels[-1][0]) > 1:
            m, lo, hi, ex = self.levels[-1]
            cut = np.arange(0, len(m), _FANOUT)
            self.levels.append((np.bitwise_or.reduceat(m, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(ex, cut)))

    def children(self, level: int, i: int) -> range:
        return range(i * _FANOUT, min((i + 1) * _FANOUT, len(self.levels[level - 1][0])))

    def leaves(self, level: int, i: int) -> range:
        width = _FANOUT**level
        return range(i * width, min((i + 1) * width, len(self.levels[0][0])))


def tree_join(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None, verified: list | None = None) -> np.ndarray:
    """For each set the index of the smallest one that verified links reach. With
    sides only pairs across the two sides are compared (others are other tasks')."""
    n = len(sets)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    tree = SignatureTree(sets)
    top = len(tree.levels) - 1

    def may_link(level: int, a: int, b: np.ndarray) -> np.ndarray:
        m, lo, hi, ex = tree.levels[level]
        common = np.bitwise_count(m[a] & m[b]).sum(axis=1).astype(np.int64) + np.minimum(ex[a], ex[b])
        most = np.minimum(common, np.minimum(hi[a], hi[b]))
        # overlap >= percent / (100 + percent) * (|A| + |B|)
        return most * (100 + percent) >= percent * (lo[a] + lo[b])

    def one(level: int, i: int) -> int:
        """The component that holds all leaves of a tree node, or -1."""
        own = tree.leaves(level, i)
        r = find(own[0])
        return r if all(find(j) == r for j in own) else -1

    stack = [(top, 0, 0)]
    while stack:
        level, a, b = stack.pop()
        if level == 0:
            if a == b or side is not None and side[a] == side[b]:
                continue
            x, y = find(a), find(b)
            if x == y:
                continue
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if verified is not None:
                verified.append((a, b))
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[max(x, y)] = min(x, y)
            continue
        if level and (r := one(level, a)) >= 0 and one(level, b) == r:
            continue
        pairs = []
        right = np.array(tree.children(level, b))
        for i in tree.children(level, a):
            others = right[right >= i] if a == b else right
            if len(others):
                pairs += [(level - 1, i, j) for j in others[may_link(level - 1, i, others)].tolist()]
        stack += pairs[::-1]
    return np.array([find(i) for i in range(n)], np.int64)


def sketch(docs: DataFrame, k: int, percent: int, text: str, id_col: str) -> DataFrame:
    """(doc_id, n_shingles, digest, signatures) of each row."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, k, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "t"):
            sets = document_sets(texts, k)
            sigs = [part_signatures(s, percent, common.value) for s in sets]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sigs])]), pa.int32())
            values = pa.array(np.concatenate([np.zeros(0, np.uint64), *sigs]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(offsets, values)],
                names=["doc_id", "n_shingles", "digest", "signatures"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, n_shingles long, digest binary, signatures array<long>")


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links each node of a run of equal signatures with the run's first."""
    last, first = None, 0
    for batch in batches:
        sig, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(sig):
            continue
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        if last == sig[0]:
            new[0] = False
        start = np.maximum.accumulate(np.where(new, np.arange(len(sig)), -1))
        head = np.where(start >= 0, doc[np.maximum(start, 0)], first)
        last, first = sig[-1], head[-1]
        some = head != doc
        if some.any():
            pairs = np.unique(np.stack([head[some], doc[some]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def classes(docs: DataFrame, k: int = 3, percent: int = 90, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: component_id is the smallest
    id that links reach, itself included. Pairs link when
    100 * |A & B| >= percent * |A | B| over sets of k-word shingles."""
    spark = docs.sparkSession
    drawn = materialise(sketch(docs, k, percent, text, id_col), "sketch")
    full = drawn.where("n_shingles > 0 and doc_id is not null")
    nodes = materialise(full.groupBy("digest").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n")), "nodes")
    n = partitions(spark)
    of_nodes = full.select("doc_id", "digest", "signatures").join(nodes.select("digest", F.col("node").alias("doc_id")), ["digest", "doc_id"])
    runs = of_nodes.select(F.explode("signatures").alias("sig"), F.col("doc_id").alias("node")).repartition(n, "sig").sortWithinPartitions("sig", "node")
    chains = runs.mapInArrow(_chains, "a long, b long").distinct()
    blocks = connected_components(chains, "blocks").select(F.col("node"), F.col("root").alias("block"))
    # sub-blocks of bounded size; one for nearly all blocks
    sized = materialise(nodes.groupBy("node").agg(F.sum("n").alias("n")).join(blocks, "node"), "blocks")
    cuts = sized.groupBy("block").agg(F.ceil(F.sum("n") / F.lit(_BLOCK_SHINGLES)).alias("cuts"))
    placed = sized.join(cuts, "block").withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    placed = placed.select("block", F.least("cut", "other").alias("lo"), F.greatest("cut", "other").alias("hi"), (F.col("cut") > F.col("other")).alias("side"), "node")

    # only texts that may be in a block leave their place
    ids = id_filter(sized, "node", sized.count())(docs.select(F.col(id_col).cast("long").alias("node"), F.col(text).alias("t")), "node")
    members = ids.join(placed, "node").repartition(n, "block", "lo", "hi").sortWithinPartitions("block", "lo", "hi", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups():
            """Like stream_groups, with sets in place of texts, so that a group holds no text."""

            def sets():
                for batch, texts in text_batches(batches, "t"):
                    own = document_sets(texts, k)
                    column = pa.array([s.tobytes() for s in own], pa.large_binary())
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "lo", "hi", "side", "node")), column], names=["block", "lo", "hi", "side", "node", "set"])

            yield from stream_groups(sets(), ["block", "lo", "hi"])

        for t in groups():
            node = t["node"].to_numpy()
            if len(node) < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in t["set"].to_pylist()]
            some = [i for i, s in enumerate(sets) if len(s)]
            if len(some) < 2:
                continue
            # neighbours in size and smallest shingle share a tree node
            order = sorted(some, key=lambda i: (len(sets[i]), sets[i][0]))
            across = t["lo"][0].as_py() != t["hi"][0].as_py()
            side = t["side"].to_numpy(zero_copy_only=False)[order] if across else None
            found = tree_join([sets[i] for i in order], percent, side)
            own = node[order]
            low = np.full(len(own), np.iinfo(np.int64).max)
            np.minimum.at(low, found, own)
            root = low[found]
            some_ = own != root
            if some_.any():
                yield pa.RecordBatch.from_arrays([pa.array(own[some_]), pa.array(root[some_])], names=["a", "b"])

    links = materialise(members.mapInArrow(run, "a long, b long"), "links")
    labels = connected_components(links, "classes")
    by_digest = nodes.join(labels.withColumnRenamed("node", "_n"), nodes["node"] == F.col("_n"), "left").select("digest", F.coalesce("root", "node").alias("class"))
    out = drawn.select("doc_id", "n_shingles", "digest").join(by_digest, "digest", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("class")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, whole, of which one document of each class stays: that with
    the smallest id. Rows with a null id stay."""
    with temporary(docs.sparkSession) as kept:
        gone = classes(docs, k, percent, text, id_col).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone_id")).distinct()
        gone, _ = kept(gone, "near-duplicates")
    return without(docs, id_col, gone, lambda d, g: d[id_col].cast("long") == g["_gone_id"])
