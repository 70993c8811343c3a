"""Exact deduplication by a minimal perfect hash over historical distinct digests.

The history's distinct digests are dealt to buckets by hash. Each bucket holds a
minimal perfect hash (levels of bit sets: a key settles on the first level where
no other key shares its bit; its slot is the rank of that bit) and, by slot, the
full digest, the winner's id and the group's size. Rows find their slot and are
members only if all 32 digest bytes agree. Nonmembers group among themselves.

Lookups meet their bucket by one shuffle of digests (never of texts): a bucket's
index row sorts before its lookups, which then stream past it. A digest that holds
more than half a partition's share of all rows (there are fewer than two such for
each partition) is spread over as many as it fills, each with its own copy of the
bucket's index row.

Null text counts as empty. Texts are equal when identical after replacing each
run of white space by one space. Of equal texts the row with the smallest id
stays; null ids come after all others; of rows that repeat both id and text one
stays. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekernel import mix
from .common import materialise, partitions, temporary, without

_KEYS_PER_BUCKET = 4_000
#: Keys of a bucket at least, where buckets are made smaller so that all partitions have some.
_LEAST_KEYS = 64
#: Rows of a digest that are never spread.
_LEAST_ROWS = 256
INDEX_SCHEMA = "bucket long, buckets long, n long, level_sizes binary, level_bits binary, slot_digests binary, slot_winners binary, slot_has_winner binary, slot_counts binary"


def digest(text):
    """Hex SHA-256 of the normalised text in UTF-8, in the JVM."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)


class MinimalPerfectHash:
    """Ranks n distinct 32-byte digests as 0..n-1 without storing them."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys[:, 0] ^ (keys[:, 1] * np.uint64(2 * level + 1))) % np.uint64(size)).astype(np.int64)

    @staticmethod
    def _keys(digests: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(digests[:, :16]).view(np.uint64).reshape(-1, 2)

    @classmethod
    def build(cls, digests: np.ndarray, gamma: float = 2.0) -> MinimalPerfectHash:
        keys, sizes, bits, level = cls._keys(digests), [], [], 0
        while len(keys):
            size = max(64, int(gamma * len(keys)))
            at = cls._place(keys, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            keys = keys[~alone[at]]
            level += 1
            if level > 200:
                raise ValueError("digests are not distinct")
        return cls(np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool))

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest; -1 for one that settles on no level. A digest
        that was not built in may get any slot."""
        keys, out = self._keys(digests), np.full(len(digests), -1, np.int64)
        open_ = np.arange(len(digests))
        for level, size in enumerate(self.sizes.tolist()):
            at = self.starts[level] + self._place(keys[open_], level, size)
            hit = self.bits[at]
            out[open_[hit]] = self.rank[at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


def _bytes(hexes: pa.Array) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(hexes.to_pylist())), np.uint8).reshape(-1, 32)


def _bucket(sha: str, n: int):
    return F.pmod(F.xxhash64(sha), F.lit(n))


def group_digests(digests: DataFrame) -> DataFrame:
    """(sha, winner, n) for each distinct digest; combined before the shuffle."""
    return digests.groupBy("sha").agg(F.min("id").alias("winner"), F.count("*").alias("n"))


def build_index(groups: DataFrame) -> DataFrame:
    """INDEX_SCHEMA, a row for each bucket, out of (sha, winner, n)."""
    keys = groups.count()
    n = max(1, -(-keys // _KEYS_PER_BUCKET), min(2 * partitions(groups.sparkSession), keys // _LEAST_KEYS))

    def build(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        digests = _bytes(t["sha"])
        mph = MinimalPerfectHash.build(digests)
        slot = mph.slots(digests)
        by_slot = np.argsort(slot)
        has = ~np.asarray(t["winner"].is_null())
        winners = t["winner"].fill_null(0).to_numpy()
        row = {
            "bucket": t["bucket"][0].as_py(), "buckets": n, "n": len(digests),
            "level_sizes": mph.sizes.tobytes(), "level_bits": np.packbits(mph.bits).tobytes(),
            "slot_digests": digests[by_slot].tobytes(), "slot_winners": winners[by_slot].astype(np.int64).tobytes(),
            "slot_has_winner": has[by_slot].tobytes(), "slot_counts": t["n"].to_numpy()[by_slot].astype(np.int64).tobytes(),
        }
        return pa.table({k: pa.array([v], pa.int64() if k in ("bucket", "buckets", "n") else pa.binary()) for k, v in row.items()})

    return groups.withColumn("bucket", _bucket("sha", n)).groupBy("bucket").applyInArrow(build, INDEX_SCHEMA)


class _Slots:
    def __init__(self, row: dict):
        sizes = np.frombuffer(row["level_sizes"], np.int64)
        self.mph = MinimalPerfectHash(sizes, np.unpackbits(np.frombuffer(row["level_bits"], np.uint8), count=int(sizes.sum())).astype(bool))
        self.digests = np.frombuffer(row["slot_digests"], np.uint8).reshape(-1, 32)
        self.winners = np.frombuffer(row["slot_winners"], np.int64)
        self.has_winner = np.frombuffer(row["slot_has_winner"], bool)
        self.counts = np.frombuffer(row["slot_counts"], np.int64)


def hot_digests(groups: DataFrame, total: int) -> DataFrame:
    """(sha, salts) of the digests that hold over half a partition's share of all rows."""
    share = max(_LEAST_ROWS, -(-total // partitions(groups.sparkSession)))
    return groups.where(F.col("n") * 2 > share).select("sha", F.ceil(F.col("n") / share).alias("salts"))


def lookup(digests: DataFrame, index: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """(id, sha, member, winner, n, first) for every row of digests (id, sha).

    first: no earlier row has the same id and digest. hot: the digests (sha, salts) of
    hot_digests(), whose rows are spread by id.
    """
    spark = digests.sparkSession
    buckets = index.agg(F.max("buckets")).first()[0] or 1
    rows = digests.withColumn("bucket", _bucket("sha", buckets))
    if hot is not None:
        rows = rows.join(F.broadcast(hot), "sha", "left").withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("id"), F.col("salts"))).otherwise(F.lit(0).cast("long"))).drop("salts")
        hot_buckets = F.broadcast(hot.groupBy(_bucket("sha", buckets).alias("bucket")).agg(F.max("salts").alias("copies")))
        index = index.join(hot_buckets, "bucket", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)).cast("long") - 1))).drop("copies")
    else:
        rows, index = rows.withColumn("salt", F.lit(0).cast("long")), index.withColumn("salt", F.lit(0).cast("long"))
    both = rows.withColumn("kind", F.lit(1)).unionByName(index.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    both = both.repartition(max(partitions(spark), 1), "bucket", "salt").sortWithinPartitions("bucket", "salt", "kind", "sha", "id")
    cols = ["kind", "id", "sha", "bucket", "level_sizes", "level_bits", "slot_digests", "slot_winners", "slot_has_winner", "slot_counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, at, last = None, None, None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            kinds, bs = t["kind"].to_numpy(), t["bucket"].to_numpy()
            cuts = np.flatnonzero((kinds[1:] != kinds[:-1]) | (kinds[1:] == 0) | (bs[1:] != bs[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(kinds)]):
                if lo == hi:
                    continue
                if kinds[lo] == 0:
                    slots, at, last = _Slots(t.slice(lo, 1).to_pylist()[0]), bs[lo], None
                    continue
                ids, sha = t["id"].slice(lo, hi - lo).combine_chunks(), t["sha"].slice(lo, hi - lo).combine_chunks()
                n = hi - lo
                member, slot = np.zeros(n, bool), np.zeros(n, np.int64)
                if slots is not None and at == bs[lo]:
                    own = _bytes(sha)
                    slot = slots.mph.slots(own)
                    found = np.flatnonzero(slot >= 0)
                    member[found] = (slots.digests[slot[found]] == own[found]).all(axis=1)
                keys = list(zip(sha.to_pylist(), ids.to_pylist()))
                first = np.array([k != p for k, p in zip(keys, [last, *keys])], bool)
                last = keys[-1]
                at_slot = np.where(member, slot, 0)
                winners = slots.winners[at_slot] if member.any() else np.zeros(n, np.int64)
                has = member & slots.has_winner[at_slot] if member.any() else member
                counts = slots.counts[at_slot] if member.any() else np.zeros(n, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids, sha, pa.array(member), pa.array(winners, pa.int64(), mask=~has), pa.array(counts, pa.int64(), mask=~member), pa.array(first)],
                    names=["id", "sha", "member", "winner", "n", "first"],
                )

    return both.select(cols).mapInArrow(run, "id long, sha string, member boolean, winner long, n long, first boolean")


def dedup(digests: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of digests.

    digests: (id long, sha string), a table that reads the same each time.
    history: the same of documents that came earlier and stay in any case; without
    it the table is its own history. group_size counts the history's rows too.
    """
    groups = materialise(group_digests(digests if history is None else history), "groups")
    index = materialise(build_index(groups), "mph")
    if history is None:
        found = lookup(digests, index, hot_digests(groups, digests.count()))
        kept = F.col("first") & F.col("id").eqNullSafe(F.col("winner"))
        return found.select(F.col("id").alias("doc_id"), F.col("winner").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))
    own = materialise(group_digests(digests), "groups")
    found = materialise(lookup(digests, index, hot_digests(own, digests.count())), "lookup")
    members = found.where("member").join(own.select("sha", F.col("n").alias("own_n")), "sha")
    members = members.select(F.col("id").alias("doc_id"), F.col("winner").alias("keep_id"), (F.col("n") + F.col("own_n")).alias("group_size"), F.lit(False).alias("kept"), F.col("sha").alias("text_sha256"))
    others = dedup(found.where("not member").select("id", "sha"))
    return members.unionByName(others)


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    def digests(df: DataFrame) -> DataFrame:
        return materialise(df.select(F.col(id_col).cast("long").alias("id"), digest(F.col(text)).alias("sha")), "digests")

    return dedup(digests(docs), None if history is None else digests(history))


def drop_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows with a null id
    stay: no id names them."""
    with temporary(docs.sparkSession) as kept:
        found = exact_dedup(docs, text=text, id_col=id_col)
        again = F.col("doc_id").eqNullSafe(F.col("keep_id"))
        gone, _ = kept(found.where("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone_id"), F.col("text_sha256").alias("_gone_sha"), again.alias("_again")).distinct(), "copies")
    repeated = gone.where("_again")
    copies = gone.where("not _again").drop("_again")
    out = without(docs, id_col, copies, lambda d, g: (d[id_col].cast("long") == g["_gone_id"]) & (digest(d[text]) == g["_gone_sha"]))
    if repeated.isEmpty():
        return out
    same = (out[id_col] == repeated["_gone_id"]) & (digest(out[text]) == repeated["_gone_sha"])
    again = out.join(repeated, same, "left_semi")
    # one row of each id and text: complete rows, so no column mixes two of them
    key = [F.col(id_col).alias("_id"), digest(F.col(text)).alias("_sha")]
    one = again.select(*key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).groupBy("_id", "_sha").agg(F.first("_row").alias("_row"))
    return out.join(repeated, same, "left_anti").unionByName(one.select("_row.*"))
