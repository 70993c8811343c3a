"""Spans of source text as column expressions. A span is a struct of path,
start_byte, end_byte, start_line, end_line; bytes may be null, and every predicate
then answers false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_range(span: Column) -> Column:
    """struct(start, end), null unless both bytes are known."""
    return F.when(span["start_byte"].isNotNull() & span["end_byte"].isNotNull(), F.struct(span["start_byte"].alias("start"), span["end_byte"].alias("end")))


def line_count(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0)) + 1


def contains(outer: Column, inner: Column) -> Column:
    return F.coalesce((outer["path"] == inner["path"]) & (outer["start_byte"] <= inner["start_byte"]) & (outer["end_byte"] >= inner["end_byte"]), F.lit(False))


def substantially_overlaps(a: Column, b: Column) -> Column:
    """The overlap is four fifths of the shorter one or more, in whole numbers."""
    overlap = F.greatest(F.least(a["end_byte"], b["end_byte"]) - F.greatest(a["start_byte"], b["start_byte"]), F.lit(0))
    shorter = F.least(F.greatest(a["end_byte"] - a["start_byte"], F.lit(0)), F.greatest(b["end_byte"] - b["start_byte"], F.lit(0)))
    return F.coalesce((a["path"] == b["path"]) & (shorter > 0) & (overlap * 5 >= shorter * 4), F.lit(False))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def covers(start: Column, end: Column, point: Column) -> Column:
    return (start <= point) & (point < end)
