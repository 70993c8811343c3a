"""Discarded errors: which sites drop a failure, how sure that is, and how far the
failure could have travelled up the callers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from . import graph
from .relational import innermost, unique_by

#: Forms of a discard.
FORMS = ["let-underscore", "ok-binding", "err-arm", "ok-discard", "unwrap-or", "cause-erased", "panic", "iterator-drop"]


def containment(declared: Column, fallible: list[str], optional: list[str], unchecked: bool = False) -> Column:
    """fallible, optional or infallible, by the names in a return type before its `<`."""
    lead = F.substring_index(declared, "<", 1)
    named = lambda names: F.coalesce(F.exists(F.array(*map(F.lit, names)), lambda n: F.instr(lead, n) > 0), F.lit(False)) if names else F.lit(False)
    other = F.lit("fallible" if unchecked else "infallible")
    return F.when(declared.isNull(), other).when(named(fallible), "fallible").when(named(optional), "optional").otherwise(other)


def with_containment(callables: DataFrame, returns: DataFrame, fallible: list[str], optional: list[str], unchecked: bool = False) -> DataFrame:
    """callables (file_id, start, end, callable_id) with their containment, by the return
    type found at the same region. Of callables at one region the smallest id stays, of
    return types (file_id, start, end, at, declared) the last, of equal ones the greatest."""
    region = ["file_id", "start", "end"]
    one = callables.groupBy(*region).agg(F.min("callable_id").alias("callable_id"))
    last = returns.groupBy(*region).agg(F.max(F.struct("at", "declared"))["declared"].alias("declared"))
    out = one.join(last, region, "left")
    return out.select(*region, "callable_id", containment(F.col("declared"), fallible, optional, unchecked).alias("containment"))


def certainty(form: Column, ambiguous: list[str]) -> Column:
    return F.when(form.isin(ambiguous), "possible").otherwise("certain")


def reported(sites: DataFrame, queries: DataFrame) -> DataFrame:
    """Sites that neither bind the cause nor (form, receiver_method of queries)
    answer a question."""
    asked = queries.select(F.col("form").alias("_f"), F.col("receiver_method").alias("_m")).distinct()
    return sites.where("not binds_cause").join(asked, (F.col("form") == F.col("_f")) & (F.col("receiver_method") == F.col("_m")), "left_anti")


def discards(sites: DataFrame, queries: DataFrame, regions: DataFrame, callables: DataFrame, ambiguous: list[str]) -> DataFrame:
    """Reported sites with their callable (or file's module), its containment, the
    certainty, the shortened expression and whether a test region holds them.

    sites: file_id, path, form, expression, receiver_method, binds_cause, at.
    regions: file_id, kind ('callable' or 'test'), name (of a callable its id), start, end.
    """
    kept = reported(sites, queries).withColumn("point_id", F.xxhash64("file_id", "at", "form", "expression"))
    held = innermost(kept, regions.where("kind = 'callable'"), "file_id", "at", "name")
    tests = regions.where("kind = 'test'").select(F.col("file_id").alias("_t"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    in_test = held.join(tests, (F.col("file_id") == F.col("_t")) & (F.col("_s") <= F.col("at")) & (F.col("at") < F.col("_e")), "left_semi").select("point_id").distinct().withColumn("in_test", F.lit(True))
    who = callables.select(F.col("callable_id").cast("string").alias("name"), "callable_id", F.col("path").alias("callable"), "containment")
    out = held.join(who, "name", "left").join(in_test, "point_id", "left")
    return out.select(
        "point_id", "file_id", "at", "form", F.coalesce("callable", N.module_of(F.col("path"))).alias("callable"), "callable_id",
        F.coalesce("containment", F.lit("infallible")).alias("containment"), certainty(F.col("form"), ambiguous).alias("certainty"),
        N.shortened(F.col("expression")).alias("expression"), F.coalesce("in_test", F.lit(False)).alias("in_test"),
    )


def call_graph(calls: DataFrame, callables: DataFrame) -> DataFrame:
    """(callee, caller): calls by a name that one callable has; none of itself."""
    by_name = unique_by(callables, ["name"], "callable_id", "callee")
    return calls.join(by_name, "name").select("callee", F.col("caller_id").alias("caller")).where("callee <> caller").distinct()


def reach(starts: DataFrame, callers: DataFrame, callables: DataFrame) -> DataFrame:
    """(start, reach, end, path) of callables with discards: local if they may fail
    themselves; unknown without callers; else ancestor, the nearest caller that may
    fail (of equally near ones the smallest); else sealed, with the farthest. path
    goes from the end down to the start."""
    own = starts.select(F.col("callable_id").alias("start")).distinct().join(callables.select(F.col("callable_id").alias("start"), "containment"), "start")
    above = graph.upward(callers, own.where("containment <> 'fallible'").select(F.col("start").alias("node")))
    state = above.join(callables.select(F.col("callable_id").alias("node"), F.col("containment").alias("c")), "node")
    best = state.groupBy("start").agg(
        F.min(F.when(F.col("c") == "fallible", F.struct("dist", "node"))).alias("near"),
        F.max(F.struct(F.col("dist"), (-F.col("node")).alias("neg"))).alias("far"),
    )
    best = best.select("start", F.when(F.col("near").isNotNull(), "ancestor").otherwise("sealed").alias("r"), F.coalesce(F.col("near.node"), -F.col("far.neg")).alias("end"))
    paths = graph.chain(above, best).select("start", "path")
    out = own.join(best, "start", "left").join(paths, "start", "left")
    kind = F.when(F.col("containment") == "fallible", "local").otherwise(F.coalesce("r", F.lit("unknown")))
    return out.select("start", kind.alias("reach"), "end", "path")
