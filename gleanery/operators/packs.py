"""Knowledge packs as relations: validity, resolution, locks, runtime capabilities."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EXACT = ["name", "language", "ecosystem", "subject", "version", "source_sha256", "compiler"]


def is_slug(x: Column) -> Column:
    return F.coalesce(x.rlike("^[a-z0-9]+([.-][a-z0-9]+)*$"), F.lit(False))


def is_sha256(x: Column) -> Column:
    return F.coalesce(F.regexp_replace(x, "^sha256:", "").rlike("^[0-9a-f]{64}$"), F.lit(False))


def is_safe_path(x: Column) -> Column:
    parts = F.split(x, "/")
    return F.coalesce((F.length(x) > 0) & ~x.startswith("/") & ~x.contains("\\") & F.forall(parts, lambda p: ~p.isin("", ".", "..")), F.lit(False))


def is_sorted_unique(x: Column) -> Column:
    return F.coalesce((F.array_sort(x) == x) & (F.size(F.array_distinct(x)) == F.size(x)), F.lit(False))


def bare_digest(x: Column) -> Column:
    return F.regexp_replace(x, "^sha256:", "")


def analyzer_digest(tag: str, inputs: Iterable[tuple[str, bytes]]) -> str:
    """The digest of an analyzer's own source: a domain tag, then each path and its
    bytes in the given order, both after their length, so that no two lists of inputs
    read alike."""
    out = hashlib.sha256(tag.encode() + b"\0")
    for path, data in inputs:
        for part in (path.encode(), data):
            out.update(len(part).to_bytes(8, "big") + part)
    return f"sha256:{out.hexdigest()}"


def compatible(a: DataFrame, b: DataFrame) -> Column:
    """Every field that must agree does; null agrees with null."""
    out = F.lit(True)
    for c in _EXACT:
        out &= a[c].eqNullSafe(b[c])
    return out


def resolve(requirements: DataFrame, manifests: DataFrame) -> DataFrame:
    """(requirement_digest, manifest_digest, revision, candidates, ambiguous): the
    compatible manifests that provide all a requirement asks for; the highest
    revision, ambiguous if several have it. Requirements nothing meets stay, null."""
    r, m = requirements.alias("r"), manifests.alias("m")
    on = F.size(F.array_except(F.col("r.capabilities"), F.col("m.provides"))) == 0
    for c in _EXACT:
        on &= F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}"))
    met = r.join(m, on).select("r.requirement_digest", "m.manifest_digest", "m.revision")
    best = met.groupBy("requirement_digest").agg(F.max("revision").alias("revision"), F.count("*").alias("candidates"))
    top = met.join(best, ["requirement_digest", "revision"]).groupBy("requirement_digest", "revision", "candidates").agg(F.count("*").alias("n"), F.min("manifest_digest").alias("digest"))
    out = requirements.select("requirement_digest").distinct().join(top, "requirement_digest", "left")
    return out.select("requirement_digest", F.when(F.col("n") == 1, F.col("digest")).alias("manifest_digest"), "revision", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("ambiguous"))


def lock_state(requirements: DataFrame, entries: DataFrame) -> DataFrame:
    """(requirement_digest, state): ok, missing, ambiguous or extra."""
    need = requirements.groupBy("requirement_digest").agg(F.count("*").alias("need"))
    have = entries.groupBy("requirement_digest").agg(F.count("*").alias("have"))
    state = F.when(F.col("need").isNull(), "extra").when(F.col("have").isNull(), "missing").when(F.col("have") > 1, "ambiguous").otherwise("ok")
    return need.join(have, "requirement_digest", "full_outer").select("requirement_digest", state.alias("state"))


def lock_drift(entries: DataFrame, cache: DataFrame) -> DataFrame:
    """Entries whose cached manifest is gone or differs."""
    own = cache.select("requirement_digest", F.col("manifest_digest").alias("cached_digest"))
    return entries.join(own, "requirement_digest", "left").where(~F.col("manifest_digest").eqNullSafe(F.col("cached_digest"))).select("requirement_digest", "manifest_digest", "cached_digest")


def lock_insert(entries: DataFrame, newer: DataFrame) -> DataFrame:
    """Entries with those of the same requirement replaced."""
    return entries.join(newer.select("requirement_digest"), "requirement_digest", "left_anti").select(entries.columns).unionByName(newer.select(entries.columns))


def missing_capabilities(manifests: DataFrame, provided: DataFrame, languages: DataFrame) -> DataFrame:
    """(name, capability) that a manifest asks of the runtime and nothing gives; each
    language gives its syntax tree."""
    given = provided.select("capability").unionByName(languages.select(F.concat("language", F.lit(".syntax-tree")).alias("capability"))).distinct()
    return manifests.select("name", F.explode("requires").alias("capability")).join(given, "capability", "left_anti").select("name", "capability").distinct()
