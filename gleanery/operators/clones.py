"""Exact and consistently renamed token clones.

tokens: file_id, path, domain, ordinal, kind, lexeme, class, start_byte, end_byte,
start_line, end_line. A window of k tokens meets equal windows by digest. Only
pairs that start or end a run are made (their neighbours before, or after, differ),
so a passage of any length costs two pairs for each two files, not one for each of
its windows; starts and ends of a diagonal are paired by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import line_count
from .lineage import cut

_MATCH = ["left_file", "left_start", "right_file", "right_start", "tokens"]


def _token(with_kind: bool = True) -> Column:
    """A token as text that no other token's text continues (lengths go first)."""
    return F.concat_ws(":", F.length("kind"), "kind", F.length("lexeme"), "lexeme")


def encoded(tokens: DataFrame, rename: tuple[str, ...] = ()) -> DataFrame:
    """tokens with code and dist: of classes that may be renamed the code is the
    class and dist the distance to the last token of that class with the same kind
    and lexeme (0: none); of others the code is the token and dist 0."""
    if not rename:
        return tokens.withColumn("code", _token()).withColumn("dist", F.lit(0))
    w = Window.partitionBy("file_id", "class", "kind", "lexeme").orderBy("ordinal")
    free = F.col("class").isin(*rename)
    back = F.coalesce(F.col("ordinal") - F.lag("ordinal").over(w), F.lit(0))
    return tokens.withColumn("code", F.when(free, F.concat(F.lit("?"), F.col("class"), F.lit(":"), F.col("kind"))).otherwise(_token())).withColumn("dist", F.when(free, back).otherwise(0).cast("int"))


def windows(coded: DataFrame, k: int, renamed: bool = True, places: bool = False) -> DataFrame:
    """(file_id, domain, start, digest, before, after): k-token windows by file, with
    the digests of their neighbours; with places also first (path, byte, line: where
    the first token begins) and last (byte, line: where the last one ends). A distance that leaves its window counts as 0.
    Without renaming a window's digest is put together from those of its halves, and
    theirs again, so it takes log2(k) steps over one sort, not k tokens a row."""
    w = Window.partitionBy("file_id").orderBy("ordinal")
    if places:
        first = F.struct("path", F.col("start_byte").alias("byte"), F.col("start_line").alias("line"))
        last = F.lead(F.struct(F.col("end_byte").alias("byte"), F.col("end_line").alias("line")), k - 1).over(w)
        coded = coded.withColumn("first", first).withColumn("last", last)
    also = ["first", "last"] * places
    if not renamed:
        rows = coded.select(*also, "file_id", "domain", "ordinal", F.struct(F.xxhash64("code").alias("a"), F.xxhash64(F.reverse("code"), F.lit(1)).alias("b")).alias("digest"))
        n = 1
        while n < k:
            # the second half may overlap the first where k is no power of two
            step = min(n, k - n)
            ahead = F.lead("digest", step).over(w)
            both = F.struct(F.xxhash64("digest.a", ahead["a"]).alias("a"), F.xxhash64("digest.b", ahead["b"], F.lit(n)).alias("b"))
            rows = rows.withColumn("digest", F.when(F.col("digest").isNotNull() & ahead.isNotNull(), both))
            n += step
        rows = rows.where("digest is not null").select(*also, "file_id", "domain", F.col("ordinal").alias("start"), "digest")
    else:
        run = F.collect_list(F.struct("code", "dist")).over(w.rowsBetween(0, k - 1))
        rows = coded.select(*also, "file_id", "domain", F.col("ordinal").alias("start"), run.alias("run")).where(F.size("run") == k)
        parts = F.transform("run", lambda t, i: F.concat_ws("#", t["code"], F.when(t["dist"] > i, 0).otherwise(t["dist"])))
        rows = rows.select(*also, "file_id", "domain", "start", F.sha2(F.concat_ws("\u0001", parts), 256).alias("digest"))
    by = Window.partitionBy("file_id").orderBy("start")
    return rows.withColumn("before", F.lag("digest").over(by)).withColumn("after", F.lead("digest").over(by))


def seeds(wins: DataFrame, k: int, edge: str | None = None, place: str | None = None) -> DataFrame:
    """Ordered pairs of equal windows that do not overlap in one file; with edge
    'before' or 'after' only those whose neighbours on that side differ. place: a
    column of the windows that goes with both sides."""
    a, b = wins.alias("a"), wins.alias("b")
    ordered = (F.col("a.file_id") < F.col("b.file_id")) | ((F.col("a.file_id") == F.col("b.file_id")) & (F.col("a.start") + k <= F.col("b.start")))
    on = (F.col("a.domain") == F.col("b.domain")) & (F.col("a.digest") == F.col("b.digest")) & ordered
    if edge:
        on &= F.col(f"a.{edge}").isNull() | F.col(f"b.{edge}").isNull() | (F.col(f"a.{edge}") != F.col(f"b.{edge}"))
    also = [F.col(f"{x}.{place}").alias(f"{side}_{place}") for x, side in (("a", "left"), ("b", "right"))] if place else []
    return a.join(b, on).select(F.col("a.file_id").alias("left_file"), F.col("a.start").alias("left_start"), F.col("b.file_id").alias("right_file"), F.col("b.start").alias("right_start"), *also)


def runs(wins: DataFrame, k: int) -> DataFrame:
    """_MATCH: maximal runs of equal windows along a diagonal; of windows with places
    also <side>_path, _from, _line, _to and _end_line of both sides."""
    places = "first" in wins.columns
    rank = lambda df: df.withColumn("diagonal", F.col("right_start") - F.col("left_start")).withColumn("r", F.row_number().over(Window.partitionBy("left_file", "right_file", "diagonal").orderBy("left_start")))
    first = rank(seeds(wins, k, "before", "first" if places else None))
    last = rank(seeds(wins, k, "after", "last" if places else None)).select("left_file", "right_file", "diagonal", "r", F.col("left_start").alias("_last"), *["left_last", "right_last"] * places)
    also = [
        F.col(f"{side}_{at}.{field}").alias(f"{side}_{name}")
        for side in ("left", "right")
        for at, field, name in (("first", "path", "path"), ("first", "byte", "from"), ("first", "line", "line"), ("last", "byte", "to"), ("last", "line", "end_line"))
    ]
    return first.join(last, ["left_file", "right_file", "diagonal", "r"]).select("left_file", "left_start", "right_file", "right_start", (F.col("_last") - F.col("left_start") + k).alias("tokens"), *also * places)


def merge_runs(pairs: DataFrame, k: int) -> DataFrame:
    """The same from all seeds, as gaps and islands."""
    w = Window.partitionBy("left_file", "right_file", "diagonal").orderBy("left_start")
    islands = pairs.withColumn("diagonal", F.col("right_start") - F.col("left_start")).withColumn("island", F.col("left_start") - F.row_number().over(w))
    return islands.groupBy("left_file", "right_file", "diagonal", "island").agg(F.min("left_start").alias("left_start"), F.min("right_start").alias("right_start"), (F.max("left_start") - F.min("left_start") + k).alias("tokens")).select(_MATCH)


def compared(matches: DataFrame, coded: DataFrame) -> DataFrame:
    """matches with changed (tokens whose text differs) and same (all codes agree
    with distances counted from the match's start)."""
    flat = matches.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tokens").cast("long") - 1)))
    one = lambda side: coded.select(F.col("file_id").alias(f"{side}_file"), F.col("ordinal").alias(f"{side}_at"), _token().alias(f"{side}_token"), F.col("code").alias(f"{side}_code"), F.col("dist").alias(f"{side}_dist"))
    both = flat.withColumn("left_at", F.col("left_start") + F.col("i")).withColumn("right_at", F.col("right_start") + F.col("i")).join(one("left"), ["left_file", "left_at"]).join(one("right"), ["right_file", "right_at"])
    within = lambda side: F.when(F.col(f"{side}_dist") > F.col("i"), 0).otherwise(F.col(f"{side}_dist"))
    same = (F.col("left_code") == F.col("right_code")) & (within("left") == within("right"))
    return both.groupBy(_MATCH).agg(F.count_if(F.col("left_token") != F.col("right_token")).alias("changed"), F.every(same).alias("same"))


def without_dominated(matches: DataFrame) -> DataFrame:
    """Matches that no other with as many tokens or more holds on both sides; ties
    of equal spans all stay."""
    other = matches.select(*[F.col(c).alias("o_" + c) for c in matches.columns])
    inside = (F.col("o_left_path") == F.col("left_path")) & (F.col("o_right_path") == F.col("right_path")) & (F.col("o_left_from") <= F.col("left_from")) & (F.col("o_left_to") >= F.col("left_to")) & (F.col("o_right_from") <= F.col("right_from")) & (F.col("o_right_to") >= F.col("right_to"))
    differs = (F.col("o_left_start") != F.col("left_start")) | (F.col("o_right_start") != F.col("right_start")) | (F.col("o_tokens") != F.col("tokens"))
    return matches.join(other, inside & (F.col("o_tokens") >= F.col("tokens")) & differs, "left_anti")


def greedy(matches: DataFrame) -> DataFrame:
    """Matches in order of tokens (descending), changed, place, each kept unless it
    substantially overlaps a kept one on both sides. Only matches of the same two
    paths can, so the pairs of paths are independent; those with one match need no
    Python."""
    key = ["left_path", "right_path"]
    counted = matches.withColumn("_n", F.count("*").over(Window.partitionBy(*key)))
    order = [F.desc("tokens"), "changed", "left_from", "left_to", "right_from", "right_to"]
    many = counted.where("_n > 1").drop("_n").sortWithinPartitions(*key, *order)

    def close(kept: tuple, row: tuple) -> bool:
        for lo, hi in ((0, 1), (2, 3)):
            shorter = min(kept[hi] - kept[lo], row[hi] - row[lo])
            if shorter <= 0 or 5 * max(0, min(kept[hi], row[hi]) - max(kept[lo], row[lo])) < 4 * shorter:
                return False
        return True

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, kept = None, []
        for rows in batches:
            keep = []
            sides = zip(*(rows[c].tolist() for c in (*key, "left_from", "left_to", "right_from", "right_to")))
            for left, right, *place in sides:
                if (left, right) != pair:
                    pair, kept = (left, right), []
                free = not any(close(k, place) for k in kept)
                if free:
                    kept.append(place)
                keep.append(free)
            yield rows[keep]

    return counted.where("_n = 1").drop("_n").unionByName(many.mapInPandas(pick, matches.schema))


def best_per_unit(matches: DataFrame, units: DataFrame) -> DataFrame:
    """Of each pair of innermost units (or spans, where no unit holds them) the match
    with the most tokens, then the fewest changed."""
    out = matches.withColumn("match_id", F.struct("left_file", "left_start", "right_file", "right_start", "tokens"))
    for side in ("left", "right"):
        held = units.select(F.col("file_id").alias(f"{side}_file"), F.col("start_byte").alias("_us"), F.col("end_byte").alias("_ue"))
        inner = out.select("match_id", f"{side}_file", f"{side}_from", f"{side}_to").join(held, f"{side}_file").where((F.col("_us") <= F.col(f"{side}_from")) & (F.col("_ue") >= F.col(f"{side}_to")))
        inner = inner.groupBy("match_id").agg(F.min_by(F.struct(F.col("_us").alias("from"), F.col("_ue").alias("to")), F.struct(F.col("_ue") - F.col("_us"), "_us")).alias("_u"))
        out = out.join(inner, "match_id", "left").withColumn(f"{side}_unit", F.coalesce("_u", F.struct(F.col(f"{side}_from").alias("from"), F.col(f"{side}_to").alias("to")))).drop("_u")
    w = Window.partitionBy("left_file", "left_unit", "right_file", "right_unit").orderBy(F.desc("tokens"), "changed", "left_start", "right_start")
    return out.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "match_id")


def clones(tokens: DataFrame, k: int = 50, min_lines: int = 5, rename: tuple[str, ...] = (), max_changed_percent: int = 30, units: DataFrame | None = None) -> DataFrame:
    """Exact clones, or with rename (classes of tokens) consistently renamed ones
    that are not exact, of which at most max_changed_percent of the tokens differ.
    With units (file_id, start_byte, end_byte) the best one of each pair of units."""
    if k < 1 or min_lines < 1 or not 0 <= max_changed_percent <= 100:
        raise ValueError("k and min_lines must be positive, the percentage at most 100")
    coded = encoded(tokens, rename)
    found = runs(cut(windows(coded, k, bool(rename), places=True)), k)
    # a run of one file whose sides overlap is dropped whole
    found = found.where("left_file <> right_file or left_start + tokens <= right_start")
    if rename:
        changed = compared(found, coded).where(f"same and changed > 0 and changed * 100 <= tokens * {max_changed_percent}").drop("same")
        found = found.join(changed, _MATCH)
    else:
        found = found.withColumn("changed", F.lit(0).cast("long"))
    long_enough = (line_count(F.col("left_line"), F.col("left_end_line")) >= min_lines) & (line_count(F.col("right_line"), F.col("right_end_line")) >= min_lines)
    out = greedy(without_dominated(cut(found.where(long_enough))))
    return out if units is None else best_per_unit(out, units).drop("left_unit", "right_unit")


def replace_files(tokens: DataFrame, newer: DataFrame) -> DataFrame:
    """tokens with all rows of the paths in newer replaced by newer's."""
    return tokens.join(newer.select("path").distinct(), "path", "left_anti").select(tokens.columns).unionByName(newer.select(tokens.columns))
