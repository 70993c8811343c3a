"""Incremental analysis: a stream of files replaces what is known by path.

Each micro-batch upserts its files' tokens into a table partitioned by a hash of
the path; only the partitions that its paths fall in are written again, to a new
version that a new, numbered pointer file then names. A pointer appears by one rename
to a name that was free, so a crash leaves the last complete state. After any sequence
of batches the table is that of a fresh run over the last state of each path."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 64


class TokenTable:
    def __init__(self, spark: SparkSession, root: str, tokenize):
        self.spark, self.root, self.tokenize = spark, root.rstrip("/"), tokenize
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}" if p else self.root)

    def _pointers(self) -> list[int]:
        """Numbers of the pointer files, in order."""
        if not self._fs.exists(self._path("")):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(self._path("")))
        return sorted(int(n[len("current-") : -len(".json")]) for n in names if n.startswith("current-") and n.endswith(".json"))

    def _named(self, number: int) -> dict[str, str]:
        return json.loads(self.spark.read.text(f"{self.root}/current-{number:012d}.json", wholetext=True).first()[0])

    def versions(self) -> dict[str, str]:
        """The folder that holds each bucket now."""
        numbers = self._pointers()
        return self._named(numbers[-1]) if numbers else {}

    def vacuum(self, keep: int = 2) -> None:
        """Deletes pointers but the last `keep` and the folders that none of those names;
        a reader of an older state must have ended. Writers must not run meanwhile."""
        numbers = self._pointers()
        kept = {v for n in numbers[-keep:] for v in self._named(n).values()}
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"current-{n:012d}.json"), False)
        for f in self._fs.listStatus(self._path("")) if numbers else []:
            name = f.getPath().getName()
            if name.startswith("v-") and name not in kept or name.startswith("next-"):
                self._fs.delete(f.getPath(), True)

    def read(self) -> DataFrame | None:
        """The table now: of each version only the bucket folders that still count."""
        by: dict[str, list[int]] = {}
        for bucket, version in self.versions().items():
            by.setdefault(version, []).append(int(bucket))
        parts = [self.spark.read.parquet(f"{self.root}/{v}").where(F.col("bucket").isin(bs)) for v, bs in sorted(by.items())]
        if not parts:
            return None
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.drop("bucket")

    def upsert(self, files: DataFrame, batch_id: int | None = None) -> None:
        """files: path, domain, text (null: the path is gone), version; of rows of one
        path the last version counts, of equal versions the greatest text."""
        w = Window.partitionBy("path").orderBy(F.desc("version"), F.desc_nulls_last("text"), F.desc("domain"))
        last = files.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
        bucket = F.pmod(F.xxhash64("path"), F.lit(BUCKETS))
        touched = [str(r[0]) for r in last.select(bucket.alias("b")).distinct().collect()]
        if not touched:
            return
        new = self.tokenize(last.where("text is not null"))
        old, now = self.read(), self.versions()
        if old is not None:
            kept = old.withColumn("bucket", bucket).where(F.col("bucket").cast("string").isin(touched)).drop("bucket").join(last.select("path").distinct(), "path", "left_anti")
            new = new.unionByName(kept.select(new.columns))
        name = f"v-{uuid.uuid4().hex[:12]}"
        new.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{self.root}/{name}")
        now |= {b: name for b in touched}
        number = max(self._pointers(), default=0) + 1
        temp, target = self._path(f"next-{name}"), self._path(f"current-{number:012d}.json")
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        if not self._fs.rename(temp, target):
            raise RuntimeError(f"{target} was written by another writer")


def follow(stream: DataFrame, table: TokenTable, checkpoint: str):
    """Starts a query that keeps the table in step with a stream of files."""
    return stream.writeStream.foreachBatch(lambda df, i: table.upsert(df, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
