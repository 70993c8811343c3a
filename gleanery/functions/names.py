"""Names, paths and callee texts as column expressions; the two that need balanced
brackets are Arrow UDFs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Directories and file-name parts that are no library source.
SKIPPED_DIRECTORIES = {
    "rust": ["tests", "benches", "examples", "target"],
    "ecmascript": ["node_modules", "test", "tests", "__tests__", "__mocks__", "spec", "dist", "build", "coverage"],
}
SKIPPED_NAME_PARTS = {"rust": r"^$", "ecmascript": r"\.test\.|\.spec\.|\.d\.ts$"}


def identifiers(text: Column) -> Column:
    return F.filter(F.split(text, "[^A-Za-z0-9_]+"), lambda x: x.rlike("^[A-Za-z_]"))


def trailing_identifier(text: Column) -> Column:
    return F.try_element_at(identifiers(text), F.lit(-1))


def is_constructor(callee: Column) -> Column:
    return F.coalesce(trailing_identifier(callee).rlike("^[A-Z]"), F.lit(False))


def simple_type_name(text: Column) -> Column:
    return F.coalesce(trailing_identifier(F.substring_index(text, "<", 1)), text)


def leaf_name(path: Column) -> Column:
    return F.substring_index(path, "::", -1)


def container_name(path: Column) -> Column:
    """The type or trait that qualifies a path: the name before its last, if upper-case."""
    before = F.try_element_at(F.split(path, "::"), F.lit(-2))
    return F.when(before.rlike("^[A-Z]"), before)


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"\s", "")


def is_public_header(header: Column) -> Column:
    return F.coalesce(header.rlike(r"^\s*pub(\s|$)"), F.lit(False))


def shortened(expression: Column) -> Column:
    """White space collapsed; over 80 characters the first 77 and dots."""
    flat = F.trim(F.regexp_replace(expression, r"\s+", " "))
    return F.when(F.length(flat) <= 80, flat).otherwise(F.concat(F.substring(flat, 1, 77), F.lit("...")))


def module_of(path: Column) -> Column:
    parts = F.split(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), "/")
    parts = F.when(F.element_at(parts, -1).isin("lib", "main", "mod"), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.when(F.size(parts) == 0, F.lit("crate")).otherwise(F.concat_ws("::", parts))


def is_library_source(path: Column, language: str = "rust") -> Column:
    parts = F.split(path, "/")
    return ~F.exists(parts, lambda p: p.isin(SKIPPED_DIRECTORIES[language])) & ~F.element_at(parts, -1).rlike(SKIPPED_NAME_PARTS[language])


def is_readable_source(text: Column) -> Column:
    return (F.octet_length(text) < 2_000_000) & F.forall(F.split(text, "\n"), lambda line: F.octet_length(line) < 400)


def _words(name: Column) -> Column:
    """Words of a CamelCase name, an acronym being one, joined by a blank."""
    return F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")


def kebab_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(_words(name), "[ _]+", "-"))


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(_words(name), "[ -]+", "_"))


def _group_end(text: str, at: int) -> int:
    """The place after the bracket that closes the one at `at`, or -1."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "<") - (text[i] == ">")
        if depth == 0:
            return i + 1
    return -1


def strip_turbofish(path: str) -> str:
    out, at = [], 0
    while (start := path.find("::<", at)) >= 0 and (end := _group_end(path, start + 2)) >= 0:
        out.append(path[at : end if path.startswith("<impl ", start + 2) else start])
        at = end
    return "".join(out) + path[at:]


def strip_generics(path: str) -> str:
    out, depth = [], 0
    for c in path:
        if c == "<":
            depth += 1
        elif c == ">":
            depth = max(depth - 1, 0)
        elif not depth:
            out.append(c)
    return "".join(out)


def _until(text: str, mark: str) -> str | None:
    """text before a mark outside all brackets, or None."""
    depth = 0
    for i, c in enumerate(text):
        if c in "<[(":
            depth += 1
        elif c in ">])":
            if not depth:
                return None
            depth -= 1
        if not depth and text.startswith(mark, i):
            return text[:i]
    return None


def self_of(path: str) -> str | None:
    """The type a qualified path names: T of `<T as Trait>::f` and of `m::<impl Trait for T>::f`."""
    if path.startswith("<"):
        return _until(path[1:], " as ")
    start = path.find("::<impl ")
    if start < 0 or (end := _group_end(path, start + 2)) < 0:
        return None
    inner = path[start + 8 : end - 1]
    trait = _until(inner, " for ")
    return inner if trait is None else inner[len(trait) + 5 :]


@F.pandas_udf(StringType())
def without_turbofish(path: pd.Series) -> pd.Series:
    return path.map(strip_turbofish, na_action="ignore")


@F.pandas_udf(StringType())
def without_generics(path: pd.Series) -> pd.Series:
    return path.map(strip_generics, na_action="ignore")


@F.pandas_udf(StringType())
def qualified_self(path: pd.Series) -> pd.Series:
    return path.map(self_of, na_action="ignore")


def type_head(expression: Column) -> Column:
    return F.substring_index(F.trim(F.substring_index(expression, "<", 1)), "::", -1)


def mentions_type(expression: Column, head: Column | str) -> Column:
    return F.array_contains(F.split(expression, "[^A-Za-z0-9_]"), head)
