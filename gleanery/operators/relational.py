"""Joins and aggregates that the analyses share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_by(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, name): the value of each key that exactly one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(value).alias(name)).where("_n = 1").drop("_n")


def resolve_unique(calls: DataFrame, callables: DataFrame) -> DataFrame:
    """calls with callee_id: a unique callable nested in the caller, else a unique
    path with the callee's last two names at its end, else a unique one of that
    name in the caller's module. A name that is not unique goes on to the next.

    calls: caller_id, caller_path, caller_module, name, pair (the last two names, or
    null), further columns. callables: callable_id, path, name, module, parent.
    """
    nested = unique_by(callables.where("parent is not null"), ["parent", "name"], "callable_id", "_nested")
    ends = F.regexp_extract("path", r"([^:]+::[^:]+)$", 1)
    pairs = unique_by(callables.withColumn("pair", F.when(ends != "", ends)).where("pair is not null"), ["pair"], "callable_id", "_pair")
    local = unique_by(callables, ["module", "name"], "callable_id", "_local")
    out = calls.join(nested.withColumnRenamed("parent", "caller_path"), ["caller_path", "name"], "left")
    out = out.join(pairs, "pair", "left").join(local.withColumnRenamed("module", "caller_module"), ["caller_module", "name"], "left")
    return out.withColumn("callee_id", F.coalesce("_nested", "_pair", "_local")).select(*calls.columns, "callee_id")


def innermost(points: DataFrame, regions: DataFrame, key: str, point: str, value: str, bucket: int = 4096) -> DataFrame:
    """points with the value of the smallest region [start, end) of the same key that
    holds the point, or null; of equal ones the first. A region meets points by the
    buckets it reaches into, so the join is on equal keys.

    points has a unique point_id.
    """
    reach = F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.greatest(F.col("end") - 1, F.col("start"))) / bucket)))
    spread = regions.select(key, F.col("start").alias("_s"), F.col("end").alias("_e"), F.col(value).alias("_v"), reach.alias("_b"))
    held = points.withColumn("_b", F.floor(F.col(point) / bucket)).join(spread, [key, "_b"]).where(F.col(point).between(F.col("_s"), F.col("_e") - 1))
    best = held.groupBy("point_id").agg(F.min_by("_v", F.struct(F.col("_e") - F.col("_s"), "_s", "_v")).alias(value))
    return points.join(best, "point_id", "left")


def accounting(df: DataFrame, bucket: Column, names: list[str]) -> DataFrame:
    """total and the count of each bucket; every row is in exactly one."""
    return df.select(bucket.alias("_b")).agg(F.count("*").alias("total"), *[F.count_if(F.col("_b") == n).alias(n) for n in names])


def histogram(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(key))


def primary_and_alternatives(df: DataFrame, form: str, name: str, delegated: Column) -> DataFrame:
    """For names that share a form: the preferred one (least delegated to, then
    shortest, then by name) and the others in that order."""
    entry = F.struct(delegated.alias("d"), F.length(name).alias("l"), F.col(name).alias("n"))
    names = F.transform(F.array_sort(F.collect_set(entry)), lambda x: x["n"])
    return df.groupBy(form).agg(names.alias("_all")).select(form, F.element_at("_all", 1).alias("primary_name"), F.slice("_all", F.lit(2), F.size("_all")).alias("alternatives"))


def top_share(df: DataFrame, key: str, limit: int) -> DataFrame:
    """The commonest keys, a report of `limit` lines, with their share of all rows."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.join(F.broadcast(total)).withColumn("percent", F.round(100.0 * F.col("n") / F.col("_t"), 1)).drop("_t").orderBy(F.desc("n"), F.asc(key)).limit(limit)


def first_appearance(df: DataFrame, group: str, value: str, order: str, name: str = "ordinal") -> DataFrame:
    """(group, value, name): 1, 2, ... for the values of a group by their first place."""
    first = df.groupBy(group, value).agg(F.min(order).alias("_first"))
    return first.select(group, value, F.row_number().over(Window.partitionBy(group).orderBy("_first", value)).alias(name))


def keep_outermost(df: DataFrame, key: str) -> DataFrame:
    """Ranges [start, end) of a key that no other, larger range holds (null-safe);
    by a running maximum over starts instead of a self-join."""
    w = Window.partitionBy(key).orderBy(F.asc("start"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_e", F.max("end").over(w)).where(F.col("_e").isNull() | (F.col("_e") < F.col("end"))).drop("_e")


def drop_wrappers(df: DataFrame, key: str) -> DataFrame:
    """Ranges that hold no other range of their key: of a nest the innermost stays."""
    w = Window.partitionBy(key).orderBy(F.desc("start"), F.asc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return df.dropDuplicates([key, "start", "end"]).withColumn("_e", F.min("end").over(w)).where(F.col("_e").isNull() | (F.col("_e") > F.col("end"))).drop("_e")


def following(items: DataFrame, parent: str, order: str, value: str) -> DataFrame:
    """items with the value of the next item under the same parent, or the parent's
    own for the last one."""
    w = Window.partitionBy(parent).orderBy(order)
    return items.withColumn("following", F.coalesce(F.lead(value).over(w), F.col(parent).cast("string")))


def apart(df: DataFrame, key: str) -> DataFrame:
    """Ranges [start, end) of a key, taken in order of start unless they overlap the
    last one taken. The state is one number, folded over a key's sorted ranges."""
    ranges = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_r"))
    first = F.struct(F.lit(None).cast("long").alias("end"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("kept"))

    def step(a, x):
        free = a["end"].isNull() | (x["start"] >= a["end"])
        own = F.struct(x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"))
        return F.struct(F.when(free, own["end"]).otherwise(a["end"]).alias("end"), F.when(free, F.concat(a["kept"], F.array(own))).otherwise(a["kept"]).alias("kept"))

    return ranges.select(key, F.explode(F.aggregate("_r", first, step)["kept"]).alias("_k")).select(key, "_k.start", "_k.end")
