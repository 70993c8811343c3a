"""Derive-macro equivalents: enums whose code a derive would write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import kebab_case, snake_case


def exhaustive(variants: DataFrame, arms: DataFrame) -> DataFrame:
    """(type, exhaustive, kebab, snake): arms (type, variant, value) name all variants
    and no others; then whether all values spell that case. Names of one word
    spell both."""
    all_ = variants.groupBy("type").agg(F.array_sort(F.collect_set("variant")).alias("v"))
    seen = arms.groupBy("type").agg(
        F.array_sort(F.collect_set("variant")).alias("a"),
        F.every(F.col("value") == kebab_case(F.col("variant"))).alias("kebab"),
        F.every(F.col("value") == snake_case(F.col("variant"))).alias("snake"),
    )
    out = all_.join(seen, "type", "left").withColumn("exhaustive", F.coalesce(F.col("v") == F.col("a"), F.lit(False)))
    fits = lambda c: (F.col("exhaustive") & F.coalesce(F.col(c), F.lit(False))).alias(c)
    return out.select("type", "exhaustive", fits("kebab"), fits("snake"))


def variant_arrays(variants: DataFrame, elements: DataFrame) -> DataFrame:
    """Types of which an array (type, pos, element) lists all variants in order."""
    listed = lambda df, x: df.groupBy("type").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", x))), lambda s: s[x]).alias(x))
    return listed(variants, "variant").join(listed(elements, "element"), "type").where(F.col("variant") == F.col("element")).select("type")


def matches(variants: DataFrame, arms: DataFrame, displays: DataFrame, elements: DataFrame, prefers: DataFrame) -> DataFrame:
    """(type, macro, case): Display in each case that the arms of a displayed type
    spell; AsRefStr in the case that is preferred (prefers: type, case), if they spell
    it, or without a preference in the only one they spell, as two cases that read
    the same decide nothing; VariantArray, without a case, where an array lists the
    variants."""
    full = exhaustive(variants, arms)
    fits = full.select("type", F.explode(F.array_compact(F.array(F.when(F.col("kebab"), "kebab-case"), F.when(F.col("snake"), "snake_case")))).alias("case"))
    wanted = prefers.groupBy("type").agg(F.min("case").alias("wanted"))
    display = fits.join(displays.select("type").distinct(), "type", "left_semi").select("type", F.lit("Display").alias("macro"), "case")
    counted = fits.join(fits.groupBy("type").agg(F.count("*").alias("n")), "type").join(wanted, "type", "left")
    named = counted.where("wanted = case or (wanted is null and n = 1)").select("type", F.lit("AsRefStr").alias("macro"), "case")
    listed = variant_arrays(variants, elements).select("type", F.lit("VariantArray").alias("macro"), F.lit(None).cast("string").alias("case"))
    return display.unionByName(named).unionByName(listed)
