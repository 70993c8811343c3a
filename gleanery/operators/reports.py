"""Reports over forms and corpora: shapes, duplication, collisions, scans, censuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shapes(subforms: DataFrame, min_size: int, max_size: int, min_files: int = 1) -> DataFrame:
    """subforms (form, size, file, line, name): each shape's distinct sites and files,
    ranked by sites, files, then form."""
    some = subforms.where(F.col("size").between(min_size, max_size))
    out = some.groupBy("form").agg(F.max("size").alias("size"), F.countDistinct("file", "line", "name").alias("sites"), F.countDistinct("file").alias("files"))
    return out.where(F.col("files") >= min_files).orderBy(F.desc("sites"), F.desc("files"), "form")


def duplication(callables: DataFrame, location: Column) -> DataFrame:
    """Forms of several callables at several locations, with how many of each."""
    return callables.withColumn("_l", location).groupBy("form").agg(F.count("*").alias("callables"), F.countDistinct("_l").alias("locations")).where("callables > 1 and locations > 1").orderBy(F.desc("callables"), F.desc("locations"), "form")


def collisions(callables: DataFrame) -> DataFrame:
    """Groups of names with one form, within one container or across them; names of
    which one begins the other do not collide."""
    own = callables.select("form", "container", "name").distinct()
    a, b = own.alias("a"), own.alias("b")
    on = (F.col("a.form") == F.col("b.form")) & (F.struct("a.container", "a.name") < F.struct("b.container", "b.name")) & ~F.col("b.name").startswith(F.col("a.name")) & ~F.col("a.name").startswith(F.col("b.name"))
    return a.join(b, on).select("a.form", F.col("a.name").alias("left_name"), F.col("b.name").alias("right_name"), (F.col("a.container") == F.col("b.container")).alias("same_container"))


def corpus_scan(finds: DataFrame) -> DataFrame:
    """One row: findings, distinct (crate, function, api), the repeats' factor, crates
    and APIs with a find, and the commonest API's share in percent."""
    by_api = finds.groupBy("api").agg(F.count("*").alias("n"))
    top = by_api.agg(F.max("n").alias("top"))
    total = finds.agg(F.count("*").alias("findings"), F.countDistinct("crate", "function", "api").alias("distinct_findings"), F.countDistinct("crate").alias("crates"), F.countDistinct("api").alias("apis"))
    return total.join(F.broadcast(top)).select("findings", "distinct_findings", F.round(F.col("findings") / F.col("distinct_findings"), 2).alias("repeat"), "crates", "apis", F.round(100.0 * F.col("top") / F.col("findings"), 1).alias("top_percent"))


def coverage(df: DataFrame, key: str, done: str, total: str) -> DataFrame:
    return df.groupBy(key).agg(F.round(100.0 * F.sum(done) / F.sum(total), 2).alias("percent"))


def first_by_order(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def markdown(shape_rows: DataFrame, duplicate_rows: DataFrame, limit: int = 20) -> str:
    """A report of the commonest shapes and duplicated forms, `limit` lines of each."""
    lines = ["# Reuse", "", "## Shapes", "", "| sites | files | size | form |", "|-:|-:|-:|-|"]
    lines += [f"| {r['sites']} | {r['files']} | {r['size']} | `{r['form']}` |" for r in shape_rows.limit(limit).collect()]
    lines += ["", "## Duplication", "", "| callables | locations | form |", "|-:|-:|-|"]
    lines += [f"| {r['callables']} | {r['locations']} | `{r['form']}` |" for r in duplicate_rows.limit(limit).collect()]
    return "\n".join(lines) + "\n"
