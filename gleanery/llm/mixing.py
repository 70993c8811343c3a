"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target in words (weights, capped at a multiple of its size, the
excess reshared). A document's expected copies are its source's target over size;
the whole part is taken, the fraction is rounded dependently: two documents with
fractions p and q exchange words at random, in either direction with the
probabilities that keep both expectations, until one is integral; the other meets
the next. Words, not copies, are conserved at every exchange, so a source's sum
stays at its target throughout.

Rounding runs in blocks of a source (dealt by hash of the id, so a source of any
size is spread), each leaving at most one fraction. These residuals meet, 64
blocks at a time, in a reduction tree of further rounds. The last one of a source
is taken in part, to the nearest word. Draws come from generators seeded by
(seed, source, level, block) over rows in order of id: reruns agree, whatever the
partitions are.

Null text has size 0; a null source is a source of its own, after all others.
Documents without words are taken round(expected) times, of 0 words. Rows are
units of their own: repeated rows and null ids are rounded like any other. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekernel import NONSPACE, buffers, spans
from .common import materialise, partitions, stream_groups, text_batches

_FAN_IN = 64
_EPS = 1e-9


def word_counts(docs: DataFrame, text: str, id_col: str, source: str) -> DataFrame:
    """(doc_id, source, size): words [^\\x20\\x09-\\x0D]+ of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "t"):
            n = np.diff(spans(*buffers(texts), NONSPACE)[2])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "size"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, source string, size long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> dict[str | None, float]:
    """Words to take of each source: weights repeat over the sources by code
    point, null last; what exceeds cap times a source's size is shared again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, rest = {}, list(names), share * sum(sizes.values())
    while free:
        unit = sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / unit > cap * sizes[s]]
        if not over:
            out.update({s: rest * weight[s] / unit for s in free})
            break
        for s in over:
            out[s] = float(cap * sizes[s])
        rest -= sum(out[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def pivotal(sizes: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """p with all but one entry 0 or 1 and the same sum of sizes * p; the index of
    the entry left over, or -1. Sizes are positive."""
    p = p.tolist()
    s = sizes.tolist()
    draws = rng.random(len(p)).tolist()
    a = -1
    for b in range(len(p)):
        if p[b] < _EPS or p[b] > 1 - _EPS:
            p[b] = round(p[b])
            continue
        if a < 0:
            a = b
            continue
        up = min((1 - p[a]) * s[a], p[b] * s[b])
        down = min(p[a] * s[a], (1 - p[b]) * s[b])
        move = up if draws[b] * (up + down) < down else -down
        p[a] += move / s[a]
        p[b] -= move / s[b]
        for x in (a, b):
            if p[x] < _EPS or p[x] > 1 - _EPS:
                p[x] = round(p[x])
        whole_a, whole_b = p[a] in (0, 1), p[b] in (0, 1)
        a = -1 if whole_a and whole_b else b if whole_a else a
    return np.array(p, float), a


def _rng(*key) -> np.random.Generator:
    return np.random.default_rng(list(hashlib.sha256(repr(key).encode()).digest()))


def _round(seed: int, level: int):
    """Rounds each run of (key, block): rows with their p, and whether p is open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in stream_groups(batches, ["key", "group"]):
            t = t.combine_chunks()
            size, p = t["size"].to_numpy(), t["p"].to_numpy().copy()
            some = np.flatnonzero(size > 0)
            p[size == 0] = np.round(p[size == 0])
            q, left = pivotal(size[some], p[some], _rng(seed, t["key"][0].as_py(), level, t["group"][0].as_py()))
            p[some] = q
            open_ = np.zeros(len(p), bool)
            if left >= 0:
                open_[some[left]] = True
            out = t.set_column(t.schema.get_field_index("p"), "p", pa.array(p)).append_column("open", pa.array(open_))
            yield from out.to_batches()

    return run


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 7, block_rows: int = 2_000, text: str = "text", id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, part_words for every row:
    copies whole copies and part_words further words of the document make taken."""
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    sized = materialise(word_counts(docs, text, id_col, source).withColumn("key", key), "sizes")
    # one row for each source
    found = {(None if r["key"] == "n" else r["key"][1:]): (r["words"], r["docs"]) for r in sized.groupBy("key").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).toLocalIterator()}
    target = targets({s: w for s, (w, _) in found.items()}, weights, share, cap)
    rows = [("n" if s is None else "s" + s, w, float(target[s]), target[s] / w if w else 0.0, -(-n // block_rows)) for s, (w, n) in found.items()]
    plan = spark.createDataFrame(rows, "key string, source_size long, target double, rate double, blocks long")
    if len(rows) <= 100_000:
        plan = F.broadcast(plan)
    units = sized.join(plan, "key").withColumn("group", F.pmod(F.xxhash64("doc_id", "size"), F.col("blocks"))).withColumn("base", F.floor(F.col("rate") + F.lit(_EPS))).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("base")))
    cols = ["key", "group", "doc_id", "size", "source_size", "target", "base", "p"]
    schema = "key string, group long, doc_id long, size long, source_size long, target double, base long, p double, open boolean"
    spread = lambda df, *order: df.repartition(partitions(spark), "key", "group").sortWithinPartitions("key", "group", *order)
    done = materialise(spread(units.select(cols), "doc_id", "size").mapInArrow(_round(seed, 0), schema), "rounded")
    # the tree: residuals are named by the block they come from
    settled, level = None, 0
    rest = done.where("open").select("key", F.col("group").alias("unit"), "size", "p", F.floor(F.col("group") / _FAN_IN).alias("group"))
    width = max((r[4] for r in rows), default=0)
    while width > 1:
        level += 1
        out = materialise(spread(rest, "unit").mapInArrow(_round(seed, level), "key string, unit long, size long, p double, group long, open boolean"), "residuals")
        width = -(-width // _FAN_IN)
        closed = out.where("not open" if width > 1 else "true").select("key", "unit", F.col("p").alias("final_p"))
        settled = closed if settled is None else settled.union(closed)
        rest = out.where("open").select("key", "unit", "size", "p", F.floor(F.col("group") / _FAN_IN).alias("group"))
    if settled is not None:
        name = [F.col("key").alias("_k"), F.col("unit").alias("_u"), "final_p"]
        settled = settled.select(*name)
        left = done.where("open").join(settled, (F.col("key") == F.col("_k")) & (F.col("group") == F.col("_u")), "left").withColumn("p", F.coalesce("final_p", "p")).select(done.columns)
        done = done.where("not open").unionByName(left)
    part = F.round(F.when((F.col("p") > 0) & (F.col("p") < 1), F.col("p") * F.col("size")).otherwise(0.0)).cast("long")
    copies = F.col("base") + F.when(F.col("p") >= 1, 1).otherwise(0)
    return done.select("doc_id", "size", "source_size", "target", (copies * F.col("size") + part).cast("long").alias("taken"), copies.cast("long").alias("copies"), part.alias("part_words"))
