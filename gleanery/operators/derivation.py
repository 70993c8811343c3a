"""Behaviours of libraries: from a public name to the term of the body that does its
work, over helpers it delegates to and types it constructs.

All relations carry a library; a name means something within its library only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import forms as T
from ..functions import names as N
from ..functions.rewrite import lift_step
from .lineage import cut

#: Methods that a language's lazy types must have, in order of preference.
CONTRACT_METHODS = {"rust": ["next", "next_back", "poll", "poll_next"], "ecmascript": ["next"]}
MAX_HOPS = 4
MAX_DEPTH = 32

_FACTS = "library string, callable_id long, name string, container string, source string, has_form boolean, works boolean, size int, target string, built string"


def resolve_within(refs: DataFrame, callables: DataFrame) -> DataFrame:
    """refs with `found`, the callable that a name means: the only one of that name in
    the reference's container, else the only one in its library; null if neither is
    unique. A callable named by `exclude` does not count.

    refs: library, name, container (or null), exclude, exclude_name, exclude_container
    (or nulls). callables: library, callable_id (unique), name, container. A name is
    counted with its two extreme ids, so that taking one out needs no list of the rest.
    """

    def only(keys: list[str], suffix: str) -> DataFrame:
        return callables.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias(f"_n{suffix}"), F.min("callable_id").alias(f"_lo{suffix}"), F.max("callable_id").alias(f"_hi{suffix}"))

    def left(suffix: str, excluded: Column) -> Column:
        n, lo, hi = F.col(f"_n{suffix}"), F.col(f"_lo{suffix}"), F.col(f"_hi{suffix}")
        gone = F.coalesce(excluded & F.col("exclude").between(lo, hi), F.lit(False))
        return F.when(n - gone.cast("int") == 1, F.when(gone & (F.col("exclude") == lo), hi).otherwise(lo))

    out = refs.join(only(["library", "container", "name"], "_q"), ["library", "container", "name"], "left")
    out = out.join(only(["library", "name"], "_g"), ["library", "name"], "left")
    same = F.col("exclude_name") == F.col("name")
    found = F.coalesce(left("_q", same & (F.col("exclude_container") == F.col("container"))), left("_g", same))
    return out.withColumn("found", found).select(*refs.columns, "found")


def principal_methods(wanted: DataFrame, methods: DataFrame, declarations: DataFrame, contract: Sequence[str]) -> DataFrame:
    """wanted with `principal`, the method that stands for a type: of the type's methods
    in the source that builds it, or, where that has none and the library declares the
    type once, of all; contract methods with a body only, by the contract's order, then
    those that do work, then the largest, then the last.

    wanted: library, type, source. methods: library, callable_id, name, container,
    source, has_form, works, size. declarations: library, type, source.
    """
    standing = F.coalesce(*[F.when(F.col("name") == n, len(contract) - i) for i, n in enumerate(contract)], F.lit(None).cast("int"))
    rank = F.when(standing.isNotNull() & F.col("has_form"), F.struct(standing.alias("standing"), "works", "size", "callable_id"))
    here = methods.dropna(subset=["container"]).groupBy("library", F.col("container").alias("type"), "source").agg(F.max(rank).alias("_here"), F.lit(True).alias("_beside"))
    once = declarations.dropna(subset=["type"]).groupBy("library", "type").agg(F.countDistinct("source").alias("_d")).where("_d = 1").drop("_d")
    anywhere = here.groupBy("library", "type").agg(F.max("_here").alias("_any")).join(once, ["library", "type"])
    out = wanted.join(here, ["library", "type", "source"], "left").join(anywhere, ["library", "type"], "left")
    return out.withColumn("principal", F.when(F.col("_beside"), F.col("_here.callable_id")).otherwise(F.col("_any.callable_id"))).select(*wanted.columns, "principal")


def _facts(callables: DataFrame) -> DataFrame:
    """What the walk needs of each callable's term, without the term."""
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for *own, text in zip(*(batch.column(i).to_pylist() for i in range(6))):
                form = None if text is None else T.loads(text)
                rows.append((*own, False, False, 0, None, None) if form is None else (*own, True, T.describes_work(form), T.metrics(form)["size"], T.delegation_target(form), T.constructed_type(form)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in _FACTS.split(", ")])

    return callables.select("library", F.col("callable_id").cast("long"), "name", "container", "source", "form").mapInArrow(run, _FACTS)


def _judged(worked: DataFrame, max_depth: int) -> DataFrame:
    """(start, form, refusal) of (start, form, inside): terms found inside one step of
    a lazy type are lifted to the whole operation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for start, text, inside in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if text is None:
                    out.append((start, None, "no-body"))
                    continue
                form = T.loads(text)
                if inside and (lifted := lift_step(form)) is not None:
                    form, text = lifted, T.dumps(lifted)
                if not (T.describes_work(form) or T.describes_decision(form)):
                    out.append((start, None, "not-comparable"))
                elif T.metrics(form)["depth"] > max_depth:
                    out.append((start, None, "too-deep"))
                else:
                    out.append((start, text, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string()))], names=["start", "form", "refusal"])

    return worked.select("start", "form", "inside").mapInArrow(run, "start long, form string, refusal string")


def derive_library(callables: DataFrame, declarations: DataFrame, contract: Sequence[str] = tuple(CONTRACT_METHODS["rust"]), max_hops: int = MAX_HOPS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(start, chain, form, refusal) of every callable: the callables its behaviour was
    followed through and the term at their end, or why there is none (no-body,
    not-comparable, too-deep).

    A body that only calls another callable, or only builds a type, is followed for up
    to `max_hops`, never to where it has been; a last body that only builds a type
    gives way to that type's principal method. The next step of a callable does not
    depend on where the walk began, so steps are found once for all callables and a
    hop is one join.

    callables: library, callable_id (long, unique), name, container (or null), source,
    form (JSON, or null). declarations: library, type, source.
    """
    facts = cut(_facts(callables))
    idle = facts.where("has_form and not works")
    refs = idle.select("library", F.col("target").alias("name"), "container", "source", F.col("callable_id").alias("exclude"), F.col("name").alias("exclude_name"), F.col("container").alias("exclude_container"), "built")
    refs = resolve_within(refs, facts).withColumn("type", F.when(F.col("built") == "Self", F.col("container")).otherwise(F.col("built")))
    steps = principal_methods(refs, facts, declarations, contract).select(F.col("exclude").alias("here"), F.col("found").alias("delegated"), "principal")
    steps = cut(steps.where("delegated is not null or principal is not null"))
    at = facts.select(F.col("callable_id").alias("start"), F.col("callable_id").alias("here"), F.array("callable_id").alias("chain"), F.lit(False).alias("inside"), F.lit(True).alias("open"))
    for _ in range(max_hops):
        to = F.coalesce("delegated", "principal")
        at = at.join(steps, "here", "left").withColumn("to", to).withColumn("goes", F.coalesce(F.col("open") & ~F.array_contains("chain", F.col("to")), F.lit(False)))
        at = at.select(
            "start", F.when(F.col("goes"), F.col("to")).otherwise(F.col("here")).alias("here"), F.when(F.col("goes"), F.array_append("chain", F.col("to"))).otherwise(F.col("chain")).alias("chain"),
            (F.col("inside") | (F.col("open") & F.col("delegated").isNull() & F.col("principal").isNotNull())).alias("inside"), F.col("goes").alias("open"),
        )
    at = cut(at).join(steps.select("here", "principal"), "here", "left")
    at = at.select("start", F.coalesce("principal", "here").alias("here"), F.when(F.col("principal").isNotNull(), F.array_append("chain", F.col("principal"))).otherwise(F.col("chain")).alias("chain"), (F.col("inside") | F.col("principal").isNotNull()).alias("inside"))
    forms = callables.select(F.col("callable_id").cast("long").alias("here"), "form")
    found = _judged(at.select("start", "here", "inside").join(forms, "here"), max_depth)
    return at.select("start", "chain").join(found, "start")


def derive_paths(asked: DataFrame, callables: DataFrame, derived: DataFrame) -> DataFrame:
    """(library, path, callable_id, chain, form, refusal) of the public paths asked for:
    library, path. A path that names no one callable is refused as no-implementation."""
    none = F.lit(None)
    refs = asked.select("library", "path", N.leaf_name(F.col("path")).alias("name"), N.container_name(F.col("path")).alias("container"), none.cast("long").alias("exclude"), none.cast("string").alias("exclude_name"), none.cast("string").alias("exclude_container"))
    found = resolve_within(refs, callables).select("library", "path", F.col("found").alias("start"))
    out = found.join(derived, "start", "left")
    return out.select("library", "path", F.col("start").alias("callable_id"), "chain", "form", F.when(F.col("start").isNull(), "no-implementation").otherwise(F.col("refusal")).alias("refusal"))


def with_catalog(behaviors: DataFrame, catalogs: DataFrame) -> DataFrame:
    """behaviors with catalog_id, the first catalog of their package, version and source
    digest; behaviours without one are left out."""
    key = ["package", "version", "source_sha256"]
    first = catalogs.dropna(subset=key).groupBy(*key).agg(F.min("catalog_id").alias("catalog_id"))
    return behaviors.join(first, key).select(*behaviors.columns, "catalog_id")


def delegated_to(behaviors: DataFrame) -> DataFrame:
    """behaviors (form, path, chain) with n_delegating: how many other paths of the
    same form reach theirs by way of this one, whose last name is in their chain
    behind its head. Steps are counted before they are joined, so a form of many
    behaviours makes no pairs."""
    steps = behaviors.select("form", "path", F.explode(F.slice("chain", F.lit(2), F.size("chain"))).alias("_leaf")).distinct()
    by = steps.groupBy("form", "_leaf").agg(F.count("*").alias("_n"))
    own = steps.withColumn("_own", F.lit(1))
    out = behaviors.withColumn("_leaf", N.leaf_name(F.col("path"))).join(by, ["form", "_leaf"], "left").join(own, ["form", "path", "_leaf"], "left")
    return out.select(*behaviors.columns, (F.coalesce("_n", F.lit(0)) - F.coalesce("_own", F.lit(0))).alias("n_delegating"))
