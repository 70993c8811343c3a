"""Call effects: classification of every call, accounting, traces, and observed
effects over resolved edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import effect_rules as rules
from ..functions import names as N
from . import graph
from .relational import accounting, resolve_unique

BUCKETS = ["linked_internal", "known_effect_origins", "constructors", "outside_selected_corpus", "dynamic_or_ambiguous", "unknown"]


def merged_catalog(catalogs: DataFrame, language: str = "rust") -> DataFrame:
    """(path, effects): of all catalogs of a language, sorted and without repeats."""
    return catalogs.where(F.col("language") == language).select("path", F.explode("effects").alias("e")).groupBy("path").agg(F.array_sort(F.collect_set("e")).alias("effects"))


def catalog_lookup(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """calls with origin and effects: the catalog's path that the callee is, or is
    before `::<`; of several the first. Both cases are equal keys: a callee is
    looked up by each of its beginnings that `::<` follows."""
    ends = F.array_compact(F.transform(F.split("callee", "::<"), lambda x, i: F.concat_ws("::<", F.slice(F.split("callee", "::<"), F.lit(1), i + 1))))
    keys = calls.select("call_id", F.explode(F.array_distinct(ends)).alias("path"))
    found = keys.join(catalog, "path").groupBy("call_id").agg(F.min(F.struct("path", "effects")).alias("f"))
    return calls.join(found.select("call_id", F.col("f.path").alias("origin"), F.col("f.effects").alias("effects")), "call_id", "left")


def classify_calls(calls: DataFrame, callables: DataFrame, catalog: DataFrame) -> DataFrame:
    """calls (call_id, caller_id, callee, span) with bucket, callee_id, origin and
    effects. In this order: catalogued, allocating, linked to one callable, a
    constructor, by a dot, by a path, unknown."""
    who = callables.select(F.col("callable_id").alias("caller_id"), F.col("path").alias("caller_path"), F.col("module").alias("caller_module"))
    own = catalog_lookup(calls.withColumn("callee", N.without_space(F.col("callee"))), catalog).join(who, "caller_id")
    ids = N.identifiers(F.col("callee"))
    own = own.withColumn("plain", N.without_generics("callee")).withColumn("name", N.trailing_identifier(F.col("callee"))).withColumn("pair", F.when(F.size(ids) >= 2, F.concat_ws("::", F.try_element_at(ids, F.lit(-2)), F.try_element_at(ids, F.lit(-1)))))
    own = resolve_unique(own.withColumn("allocates", rules.allocating_call(F.col("plain"))), callables)
    bucket = (
        F.when(F.col("origin").isNotNull() | F.col("allocates").isNotNull(), "known_effect_origins")
        .when(F.col("callee_id").isNotNull(), "linked_internal")
        .when(N.is_constructor(F.col("callee")), "constructors")
        .when(F.col("callee").contains("."), "dynamic_or_ambiguous")
        .when(F.col("callee").contains("::"), "outside_selected_corpus")
        .otherwise("unknown")
    )
    by_allocation = F.col("origin").isNull() & F.col("allocates").isNotNull()
    return (
        own.withColumn("bucket", bucket)
        .withColumn("effects", F.when(by_allocation, F.array(F.lit("allocate"))).otherwise(F.col("effects")))
        .withColumn("origin", F.when(by_allocation, F.concat(F.lit("rust:allocation:"), F.col("allocates"))).otherwise(F.col("origin")))
        .withColumn("callee_id", F.when(F.col("bucket") == "linked_internal", F.col("callee_id")))
        .select("call_id", "caller_id", "callee", "name", "span", "bucket", "callee_id", "origin", "effects")
    )


def call_accounting(classified: DataFrame) -> DataFrame:
    return accounting(classified, F.col("bucket"), BUCKETS)


def seeds_and_flows(classified: DataFrame, macros: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    seeds = classified.where("origin is not null").select(F.col("caller_id").alias("node"), F.explode("effects").alias("label"), "origin", "span")
    if macros is not None:
        more = macros.withColumn("operation", rules.allocating_macro(F.col("name"), F.col("has_arguments"))).where("operation is not null")
        seeds = seeds.unionByName(more.select(F.col("caller_id").alias("node"), F.lit("allocate").alias("label"), F.concat(F.lit("rust:allocation:"), "operation").alias("origin"), "span"))
    flows = classified.where("callee_id is not null").select(F.col("caller_id").alias("into"), F.col("callee_id").alias("from"), "span")
    return seeds.distinct(), flows.distinct()


def traces(seeds: DataFrame, flows: DataFrame, callables: DataFrame, one_each: bool = False) -> DataFrame:
    """(callable_id, path, effect, origin, route): one for each site a callable
    reaches, or with one_each one for each callable and effect."""
    names = callables.select(F.col("callable_id").alias("node"))
    found = graph.witnesses(flows, seeds, names)
    if one_each:
        found = graph.first_witness(found)
    return found.join(callables.select(F.col("callable_id").alias("start"), F.col("path").alias("callable")), "start").select(F.col("start").alias("callable_id"), "callable", F.col("label").alias("effect"), "origin", "origin_span", F.col("path").alias("route")).distinct()


def effects_by_path(traced: DataFrame, public: DataFrame) -> DataFrame:
    """(path, effects) of public callables."""
    return traced.join(public.select("callable_id"), "callable_id", "left_semi").groupBy(F.col("callable").alias("path")).agg(F.array_sort(F.collect_set("effect")).alias("effects"))


def unresolved_diagnostics(classified: DataFrame, callables: DataFrame, effectful: DataFrame) -> DataFrame:
    """Calls without a target whose name an effectful callable has."""
    left = classified.where(F.col("bucket").isin("dynamic_or_ambiguous", "outside_selected_corpus", "unknown"))
    risky = callables.join(effectful.select("callable_id").distinct(), "callable_id", "left_semi").select("name").distinct()
    who = callables.select(F.col("callable_id").alias("caller_id"), F.col("path").alias("caller"))
    text = F.format_string("call `%s` in %s may target an effectful local callable but could not be resolved uniquely", "callee", "caller")
    return left.join(risky, "name", "left_semi").join(who, "caller_id").select("caller", "span", text.alias("message")).distinct()


def classify_edges(edges: DataFrame, definitions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Resolved edges (edge_id, from, to, span) with their bucket: by catalog, by
    definition, by allocation of the destination, else outside. An edge with several
    targets is counted once, by its first."""
    to = edges.select("edge_id", "from", "span", F.posexplode("to").alias("pos", "destination"))
    to = to.withColumn("path", N.without_turbofish("destination"))
    to = to.withColumn("allocates", rules.allocating_destination(F.col("destination"), F.col("path"), N.without_generics("destination"), N.qualified_self("path")))
    known = definitions.select(F.col("id").alias("destination"), F.lit(True).alias("defined"))
    to = to.join(catalog, "path", "left").join(known, "destination", "left")
    bucket = F.when(F.col("effects").isNotNull(), "known_effect_origins").when(F.col("defined"), "linked_internal").when(F.col("allocates").isNotNull(), "known_effect_origins").otherwise("outside_selected_corpus")
    return to.withColumn("bucket", bucket).withColumn("counted", F.col("pos") == 0)


def observed_diagnostics(edges: DataFrame, definitions: DataFrame) -> DataFrame:
    """(edge_id, from, span, bucket, message) of edges that no call can be made of:
    their caller was not observed, or they resolve to nothing."""
    known = definitions.select(F.col("id").alias("from"), F.lit(True).alias("_d")).distinct()
    lost = F.col("_d").isNull()
    message = F.when(lost, F.format_string("call from unobserved definition %s", F.col("from"))).otherwise(F.format_string("call in %s was resolved to no destination", F.col("from")))
    out = edges.join(known, "from", "left").where(lost | (F.coalesce(F.size("to"), F.lit(0)) <= 0))
    return out.select("edge_id", "from", "span", F.when(lost, "unknown").otherwise("dynamic_or_ambiguous").alias("bucket"), message.alias("message"))


def observed_accounting(edges: DataFrame, definitions: DataFrame, catalog: DataFrame) -> DataFrame:
    """total and the count of each bucket over resolved edges, each in one: the first
    of its targets that is known decides, else it is outside."""
    bad = observed_diagnostics(edges, definitions).select("edge_id", "bucket")
    good = classify_edges(edges.join(bad, "edge_id", "left_anti"), definitions, catalog)
    first = good.groupBy("edge_id").agg(F.coalesce(F.min_by("bucket", F.when(F.col("bucket") != "outside_selected_corpus", F.col("pos"))), F.lit("outside_selected_corpus")).alias("bucket"))
    return accounting(first.unionByName(bad), F.col("bucket"), BUCKETS)


def with_inputs(traced: DataFrame, evidence: DataFrame) -> DataFrame:
    """(trace_id, inputs) of (trace_id, paths): the evidence, ordered and without
    repeats, of every file that a trace's callable and calls lie in; paths without
    evidence add nothing. evidence: path (unique) and further columns."""
    own = evidence.select("path", F.struct(*evidence.columns).alias("_e"))
    found = traced.select("trace_id", F.explode(F.array_distinct("paths")).alias("path")).join(own, "path")
    inputs = found.groupBy("trace_id").agg(F.array_sort(F.collect_set("_e")).alias("inputs"))
    out = traced.select("trace_id").distinct().join(inputs, "trace_id", "left")
    return out.withColumn("inputs", F.coalesce("inputs", F.array().cast(inputs.schema["inputs"].dataType)))


def missing_ends(edges: DataFrame, definitions: DataFrame) -> DataFrame:
    """Callers of edges that no definition has."""
    return edges.join(definitions.select(F.col("id").alias("from")), "from", "left_anti").select(F.col("from").alias("missing_caller"), "span").distinct()
