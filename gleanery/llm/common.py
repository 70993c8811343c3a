"""What the operators of this subpackage share: the shared folder, tables written
there to cut lineage, streaming of grouped rows through Arrow, and connected
components."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths of the shared folder, by the temporary() block they were written in, and of no block.
_blocks: list[list[str]] = []
_left: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only where the session names none (tests, a local master) a folder under the
    system's temporary one is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        base = "file://" + os.path.join(tempfile.gettempdir(), "gleanery-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is there is deleted at the end of the
    temporary() block, or else, as live results may read it, when Python ends."""
    path = f"{shared_dir(spark)}/gleanery/{name}-{uuid.uuid4().hex[:12]}"
    if not _left and not _blocks:
        atexit.register(_sweep, spark)
    (_blocks[-1] if _blocks else _left).append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: a cut of the lineage
    that survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that is no longer read."""
    for paths in (*_blocks, _left):
        if path in paths:
            paths.remove(path)
    delete_path(spark, path)


def _sweep(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:
        for path in _left:
            delete_path(spark, path)
    _left.clear()


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], tuple[DataFrame, str]]]:
    """Deletes, at the end, the tables written inside, and those only: nothing that an
    earlier result reads. What it gives writes a table that outlives the block, and
    returns it and its path."""
    own: list[str] = []
    _blocks.append(own)

    def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        out, path = materialise(df, name), own.pop()
        (_blocks[-2] if len(_blocks) > 1 else _left).append(path)
        return out, path

    try:
        yield kept
    finally:
        _blocks.pop()
        for path in own:
            delete_path(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Arrow batches between Spark and Python hold about `most` bytes at most, from now on
    and in this session, as plans read the setting when they run. Else a task's whole
    texts (64 MB) are one batch, several times in memory on both sides. A smaller
    setting stays; rows are the same ones, in the same order."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > most:
        spark.conf.set(key, str(most))


def text_batches(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches that hold about max_bytes of text each (at least one
    row), with nulls of the text column as empty strings."""
    for batch in batches:
        whole = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(whole), 0).to_numpy(zero_copy_only=False)

        def part(at: int, n: int, whole=whole) -> pa.Array:
            """Only a slice is copied, never the batch."""
            return pc.fill_null(whole.slice(at, n).cast(pa.large_string()), "")

        lo = n = 0
        for i, s in enumerate(sizes.tolist()):
            if n and n + s > max_bytes:
                yield batch.slice(lo, i - lo), part(lo, i - lo)
                lo, n = i, 0
            n += s
        if lo < batch.num_rows:
            yield batch.slice(lo), part(lo, batch.num_rows - lo)


def stream_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, out of batches sorted by them. Nulls of a key
    are equal."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        ids = list(zip(*cols))
        lo = 0
        for i, k in enumerate(ids):
            if last is not None and k != last:
                if i > lo:
                    rest.append(batch.slice(lo, i - lo))
                yield pa.Table.from_batches(rest)
                rest, lo = [], i
            last = k
        if lo < batch.num_rows:
            rest.append(batch.slice(lo))
    if rest:
        yield pa.Table.from_batches(rest)


def id_filter(ids: DataFrame, column: str, n: int, most_bits: int = 1 << 29):
    """A function of frames: their rows whose id may be among ids, and all of those
    that are. It carries a bit for each of some hash values, 16 for each of the n
    ids but at most most_bits (64 MB) in all, which bounds what is broadcast; with
    more ids than that it lets more rows through, and what is joined afterwards
    stays the same."""
    spark = ids.sparkSession
    bits = 1 << 15
    while bits < min(16 * n, most_bits):
        bits *= 2
    at = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(bits))
    own = ids.select((at(F.col(column)) + 1).alias("p"))  # bucket and bit numbers count from 1 and 0
    maps = own.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    field = bytearray(bits // 8)
    for r in maps.toLocalIterator():
        lo = (r["b"] - 1) * 4096
        field[lo : lo + 4096] = r["m"]
    shared = spark.sparkContext.broadcast(bytes(field))

    def keep(df: DataFrame, id_col: str, others: bool = False) -> DataFrame:
        """Rows that may be among ids; with others all the other rows, those with a
        null id among them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flags = np.frombuffer(shared.value, np.uint8)
            for batch in batches:
                column = batch.column(batch.num_columns - 1)
                p = column.fill_null(0).to_numpy()
                hit = ((flags[p >> 3] >> (p & 7).astype(np.uint8)) & 1).astype(bool) & column.is_valid().to_numpy(zero_copy_only=False)
                kept = batch.filter(pa.array(hit != others))
                yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=kept.schema.names[:-1])

        place, name = F.when(F.col(id_col).isNotNull(), at(F.col(id_col).cast("long"))), "_p"
        while name in {c.lower() for c in df.columns}:
            name += "_"
        return df.withColumn(name, place).mapInArrow(run, df.schema)

    return keep


#: Rows that are broadcast at most: about 10 MB of ids and digests.
MOST_BROADCAST = 100_000


def without(docs: DataFrame, id_col: str, gone: DataFrame, on, most: int | None = None) -> DataFrame:
    """The rows of docs that meet no row of gone (_gone_id, ...) under on, which holds
    equal ids at least. A short list is broadcast. With a long one only the rows
    whose id may be in it are shuffled: all others, texts and all, stay where they
    are, at the cost of a second scan."""
    n = gone.count()
    if n <= (MOST_BROADCAST if most is None else most):
        return docs.join(F.broadcast(gone), on(docs, gone), "left_anti")
    keep = id_filter(gone, "_gone_id", n)
    some = keep(docs, id_col)
    return keep(docs, id_col, others=True).unionByName(some.join(gone, on(some, gone), "left_anti"))


def _with_least(edges: DataFrame, rows: int) -> DataFrame:
    """edges (a, b) with m, the smallest b of their a. The edges of a hub are dealt over
    as many keys as its degree asks for. Of at most `rows` edges fewer than
    MOST_BROADCAST nodes can have a degree above the limit, so the list of hubs that
    is broadcast is bounded at any size."""
    most = max(1_000, rows // max(MOST_BROADCAST, 1))
    low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", "m", F.ceil(F.col("n") / most).alias("k"))
    hubs = low.where("k > 1").select("a", "k")
    own = edges.join(F.broadcast(hubs), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("k", F.lit(1))).alias("s"))
    return own.join(low.select("a", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("s")), ["a", "s"]).select("a", "b", "m")


def connected_components(edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node that
    links reach. Alternates large-star and small-star steps, each round written to
    the shared folder, until the edges are a set of stars. No node's neighbours are
    ever gathered in one row, and a hub's edges are dealt over several keys.
    """
    spark = edges.sparkSession

    def written(df: DataFrame, i: int) -> tuple[DataFrame, str]:
        path = scratch_path(spark, f"{name}-{i}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    def signature(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    state, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), 0)
    before = signature(state)
    for i in range(max_rounds):
        if not before[0]:
            break
        both = state.union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, 2 * before[0]).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        small = _with_least(large, 2 * before[0])
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        old = path
        state, path = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), i + 1)
        delete_path(spark, old)
        now = signature(state)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled in {max_rounds} rounds")
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def lazily(make: Callable):
    """make() once in each Python worker, at first use."""
    box: list = []

    def get():
        if not box:
            box.append(make())
        return box[0]

    return get
