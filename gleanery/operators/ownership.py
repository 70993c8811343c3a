"""Ownership of pointer fields: an ordered list of rules over declarations, another
over evidence. The first rule that holds decides; each carries the precision once
measured for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of links, types of the collected heap, getters of singletons.
LINK_NAMES = ["next", "prev", "next_req", "prev_req", "head", "tail", "next_free", "next_to_free", "endgame_next"]
HEAP_TYPES = ["JSGlobalObject", "JSPromise", "JSValue", "JSObject", "JSFunction", "JSCell", "JSString", "VirtualMachine", "CallFrame"]
SINGLETON_GETTERS = ["initGlobal", "bunVM", "getVM", "vm", "instance"]
#: Fixed values, in order: rule, class, mean and worst precision in percent.
DECLARATION_RULES = [
    ("extern-link", "INTRUSIVE", 75.0, 8.0),
    ("extern-container", "FFI", 91.6, 76.0),
    ("jsc-type", "JSC_BORROW", 83.2, 77.0),
    ("fn-pointer", "STATIC", 76.4, 42.0),
    ("link-name", "INTRUSIVE", 90.3, 0.0),
    ("parent-name", "BACKREF", 81.8, 50.0),
]
EVIDENCE_RULES = [("arena-store", "ARENA", 100.0, 100.0), ("ref-counted", "SHARED", 86.3, 60.0), ("global-singleton", "STATIC", 75.0, 0.0)]
OWNING = ["OWNED", "SHARED", "ARENA"]


def plain_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "^[#_]+", ""))


def declaration_rule(is_extern: Column, name: Column, type_: Column) -> Column:
    """The rule that decides a field, or null; only types with a pointer have one."""
    own = plain_name(name)
    link = own.isin(LINK_NAMES)
    heap = F.arrays_overlap(F.split(type_, "[^A-Za-z0-9_]"), F.array(*map(F.lit, HEAP_TYPES)))
    function = type_.rlike(r"(^|[^A-Za-z0-9_])fn\s*\(")
    rule = F.when(is_extern & link, "extern-link").when(is_extern, "extern-container").when(heap, "jsc-type").when(function, "fn-pointer").when(link, "link-name").when(own.isin("parent", "owner"), "parent-name")
    return F.when(type_.contains("*"), rule)


def _explained(df: DataFrame, rules: list[tuple]) -> DataFrame:
    dim = df.sparkSession.createDataFrame(rules, "rule string, class string, precision double, worst_precision double")
    return df.join(F.broadcast(dim), "rule").withColumn("can_double_free", F.col("class").isin(OWNING))


def classify(fields: DataFrame) -> DataFrame:
    """fields (field_id, container_kind, name, zig_type) that a declaration settles."""
    rule = declaration_rule(F.col("container_kind").startswith("extern"), F.col("name"), F.col("zig_type"))
    return _explained(fields.withColumn("rule", rule).where("rule is not null"), DECLARATION_RULES)


def classify_with_evidence(fields: DataFrame, assignments: DataFrame, calls: DataFrame) -> DataFrame:
    """fields that assignments (field_id, value) or calls (field_id, method) settle."""
    value = F.col("value")
    given = assignments.groupBy("field_id").agg(F.bool_or(value.contains("Store.append")).alias("arena"), F.bool_or(F.exists(F.array(*[F.lit(g + "(") for g in SINGLETON_GETTERS]), lambda g: value.contains(g))).alias("single"))
    called = calls.groupBy("field_id").agg(F.bool_or(F.col("method").isin("ref", "deref")).alias("counted"))
    rule = F.when(F.col("arena"), "arena-store").when(F.col("counted"), "ref-counted").when(F.col("single"), "global-singleton")
    out = fields.join(given, "field_id", "left").join(called, "field_id", "left").withColumn("rule", F.when(F.col("zig_type").contains("*"), rule)).drop("arena", "single", "counted")
    return _explained(out.where("rule is not null"), EVIDENCE_RULES)


def scored(classified: DataFrame, truth: DataFrame, folds: int = 5) -> DataFrame:
    """Per class and fold (by an FNV-1a hash of the file): answers and right ones."""
    own = classified.join(truth.select("field_id", F.col("class").alias("true_class")), "field_id")
    return own.withColumn("fold", F.pmod(fnv1a(F.col("file")), F.lit(folds))).groupBy("class", "fold").agg(F.count("*").alias("answers"), F.count_if(F.col("class") == F.col("true_class")).alias("right_answers"))


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of a text's bytes, as a non-negative number below 2^63. The
    product is taken in halves, as a long would overflow."""
    low, high = F.lit(0x1B3), F.lit(0xFFFFFFFF)

    def step(h: Column, byte: Column) -> Column:
        x = h.bitwiseXOR(byte)
        a, b = x.bitwiseAND(high), F.shiftrightunsigned(x, 32)
        # times 2^40 + 0x1b3, modulo 2^64
        t = a * low
        carry = F.shiftrightunsigned(t, 32)
        top = (b * low + carry + F.shiftleft(a.bitwiseAND(F.lit(0xFFFFFF)), 8)).bitwiseAND(high)
        return F.shiftleft(top, 32).bitwiseOR(t.bitwiseAND(high))

    bytes_ = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.substring(F.hex(F.encode(text, "UTF-8")), (i * 2 - 1).cast("int"), F.lit(2)), 16, 10).cast("long"))
    start = F.lit(-3750763034362895579).cast("long")
    h = F.when(F.octet_length(text) > 0, F.aggregate(bytes_, start, step)).otherwise(start)
    return F.shiftrightunsigned(h, 1)
