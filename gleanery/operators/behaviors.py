"""Behaviours: library terms, matched with a repository's functions.

Terms are rows (JSON). A library term meets a function only where the function has
all of its anchors: they are joined on the library term's rarest anchor, checked
for the rest, and only then unified in an Arrow function.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import forms as T
from ..functions.rewrite import simplify
from ..functions.unify import contains, locate
from .lineage import cut
from .relational import unique_by

NODES = "node_id int, parent_id int, depth int, ordinal int, tag string, name string, own_size int, own_anchors int, decides boolean"


@F.pandas_udf(StringType())
def canonical_text(form: pd.Series) -> pd.Series:
    """The S-expression of a term with its names numbered, the key of equality."""
    return form.map(lambda x: str(T.canonical(T.loads(x))), na_action="ignore")


@F.pandas_udf(StringType())
def simplified(form: pd.Series) -> pd.Series:
    return form.map(lambda x: T.dumps(T.canonical(simplify(T.loads(x)))), na_action="ignore")


def node_table(forms: DataFrame) -> DataFrame:
    """(form_id, NODES) of forms (form_id, form)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *r) for i, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if f is not None for r in T.node_rows(T.loads(f))]
            if rows:
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["form_id", *[x.split()[0] for x in NODES.split(", ")]])

    return forms.select(F.col("form_id").cast("long"), "form").mapInArrow(run, f"form_id long, {NODES}")


def metrics(nodes: DataFrame) -> DataFrame:
    """(form_id, size, depth, anchors, holes, reportable) by aggregation of nodes."""
    work = F.bool_or(F.col("tag").isin(sorted(T._WORK)) | F.col("decides"))
    out = nodes.groupBy("form_id").agg(F.sum("own_size").alias("size"), F.max("depth").alias("depth"), F.sum("own_anchors").alias("anchors"), F.countDistinct(F.when(F.col("tag") == "free", F.col("name"))).alias("holes"), work.alias("work"))
    return out.withColumn("reportable", F.expr("size >= 6 and anchors >= 2 and anchors >= holes and work")).drop("work")


def anchor_rows(nodes: DataFrame) -> DataFrame:
    """(form_id, anchor) of nodes, as forms.anchor_names."""
    letter = F.create_map(*[F.lit(x) for kv in {**T.ANCHORS, "opaque": "k"}.items() for x in kv])
    return nodes.where(F.col("tag").isin([*T.ANCHORS, "opaque"])).select("form_id", F.concat(letter[F.col("tag")], F.lit(":"), "name").alias("anchor")).distinct()


def candidates(library: DataFrame, functions: DataFrame) -> DataFrame:
    """(library_id, function_id) whose function has every anchor of the library
    term. Both: (form_id, form)."""
    has = anchor_rows(node_table(functions))
    needs = cut(anchor_rows(node_table(library)).withColumnRenamed("form_id", "library_id"))
    counts = has.join(needs.select("anchor").distinct(), "anchor", "left_semi").groupBy("anchor").agg(F.count("*").alias("n"))
    rarest = needs.join(counts, "anchor", "left").groupBy("library_id").agg(F.min_by("anchor", F.struct(F.coalesce("n", F.lit(0)), "anchor")).alias("anchor"), F.count("*").alias("all_n"))
    some = rarest.join(has.withColumnRenamed("form_id", "function_id"), "anchor").select("library_id", "function_id", "all_n")
    met = some.join(needs, "library_id").join(has.withColumnRenamed("form_id", "function_id"), ["function_id", "anchor"]).groupBy("library_id", "function_id", "all_n").agg(F.count("*").alias("n"))
    return met.where("n = all_n").select("library_id", "function_id")


def match(library: DataFrame, functions: DataFrame) -> DataFrame:
    """(library_id, function_id, mode, places): library terms that functions hold, as
    written ('exact') or else fused, never of the source they are derived from.

    library: library_id, language, source_sha256, form; functions: function_id,
    language, source_sha256, form. Forms are simplified ones.
    """
    pairs = candidates(library.select(F.col("library_id").alias("form_id"), "form"), functions.select(F.col("function_id").alias("form_id"), "form"))
    lib = library.select("library_id", F.col("language").alias("_l"), F.col("source_sha256").alias("_s"), F.col("form").alias("pattern"))
    full = pairs.join(lib, "library_id").join(functions.select("function_id", "language", "source_sha256", F.col("form").alias("subject")), "function_id")
    full = full.where((F.col("language") == F.col("_l")) & ~F.regexp_replace("_s", "^sha256:", "").eqNullSafe(F.regexp_replace("source_sha256", "^sha256:", "")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lib_id, fn, pattern, subject in zip(*(batch.column(i).to_pylist() for i in range(4))):
                p, s = T.loads(pattern), T.loads(subject)
                for mode in ("exact", "fused"):
                    if contains(s, p, mode == "fused"):
                        out.append((lib_id, fn, mode, [{"first": a, "last": b} for _, a, b in locate(s, p, mode == "fused")]))
                        break
            if out:
                place = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), place))], names=["library_id", "function_id", "mode", "places"])

    return full.select("library_id", "function_id", "pattern", "subject").mapInArrow(run, "library_id long, function_id long, mode string, places array<struct<first:int,last:int>>")


def delegations(callables: DataFrame, max_hops: int = 4) -> DataFrame:
    """(start, callable_id, hops, form): each callable followed through bodies that
    only call another one, by unique name, to the body that does work.

    callables: callable_id, name, form, delegates_to (a name, or null).
    """
    by_name = unique_by(callables, ["name"], "callable_id", "target")
    step = cut(callables.join(by_name.withColumnRenamed("name", "delegates_to"), "delegates_to", "left").select("callable_id", "target"))
    at = callables.select(F.col("callable_id").alias("start"), "callable_id", F.lit(0).alias("hops"))
    for i in range(max_hops):
        nxt = step.where("target is not null").select(F.col("callable_id"), "target")
        at = at.join(nxt, "callable_id", "left").select("start", F.coalesce("target", "callable_id").alias("callable_id"), F.when(F.col("target").isNull(), F.col("hops")).otherwise(i + 1).alias("hops"))
    return at.join(callables.select("callable_id", "form"), "callable_id").select("start", "callable_id", "hops", "form")


def python_forms(files: DataFrame) -> DataFrame:
    """(path, name, start_line, end_line, form) of files (path, text) of Python; files
    that do not parse have one row with a null name and the reason as form."""
    from ..sources.python_frontend import functions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(path, n, a, b, T.dumps(f)) for n, a, b, f in functions(text or "")]
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["path", "name", "start_line", "end_line", "form"])

    return files.select("path", "text").mapInArrow(run, "path string, name string, start_line int, end_line int, form string")


def derive(callables: DataFrame, max_depth: int = 32) -> DataFrame:
    """(start, callable_id, form, refusal) of a library's callables (callable_id, name,
    form, delegates_to): the term of the body that does the work, or why there is
    none: no-implementation (it delegates to a name that is not unique or not here),
    no-body, too-deep, not-comparable."""
    worked = delegations(callables).join(callables.select("callable_id", "delegates_to"), "callable_id")
    m = metrics(node_table(worked.where("form is not null").select(F.col("start").alias("form_id"), "form"))).select(F.col("form_id").alias("start"), "depth", "reportable")
    reason = (
        F.when(F.col("delegates_to").isNotNull(), "no-implementation")
        .when(F.col("form").isNull(), "no-body")
        .when(F.col("depth") > max_depth, "too-deep")
        .when(~F.col("reportable"), "not-comparable")
    )
    out = worked.join(m, "start", "left").withColumn("refusal", reason)
    return out.select("start", "callable_id", F.when(F.col("refusal").isNull(), F.col("form")).alias("form"), "refusal")


def opacity(nodes: DataFrame) -> DataFrame:
    """Per kind of opaque term how often it occurs, and its share of all terms in percent."""
    total = nodes.agg(F.count("*").alias("_t"))
    own = nodes.where("tag = 'opaque'").groupBy("name").agg(F.count("*").alias("n"))
    return own.join(F.broadcast(total)).select("name", "n", F.round(100.0 * F.col("n") / F.col("_t"), 3).alias("percent"))
