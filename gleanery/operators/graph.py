"""Propagation over graphs: label closure, witnesses, reach. Each is a loop on the
driver over frames: a round is one join of the frontier with the edges, and its
result is checkpointed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def closure(flows: DataFrame, seeds: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """The least (node, label) with the seeds (node, label) and, for each flow
    (into, from), every label of from at into. Semi-naive: a round joins only what
    the last one added."""
    edges = flows.select(F.col("into").alias("_to"), F.col("from").alias("node")).distinct()
    known = cut(seeds.select("node", "label").distinct())
    new = known
    for _ in range(max_rounds):
        step = new.join(edges, "node").select(F.col("_to").alias("node"), "label").distinct()
        new = cut(step.join(known, ["node", "label"], "left_anti"))
        if new.isEmpty():
            return known
        known = cut(known.unionByName(new))
    raise RuntimeError("closure not reached")


def distances(flows: DataFrame, seeds: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(node, label, dist): edges from the nearest seed of the label. flows whose end
    has no name must be left out beforehand."""
    edges = flows.select(F.col("into").alias("_to"), F.col("from").alias("node")).distinct()
    known = cut(seeds.select("node", "label").distinct().withColumn("dist", F.lit(0)))
    new = known
    for i in range(1, max_rounds):
        step = new.join(edges, "node").select(F.col("_to").alias("node"), "label").distinct()
        new = cut(step.join(known, ["node", "label"], "left_anti").withColumn("dist", F.lit(i)))
        if new.isEmpty():
            return known
        known = cut(known.unionByName(new))
    raise RuntimeError("distances not settled")


def witnesses(flows: DataFrame, seeds: DataFrame, names: DataFrame) -> DataFrame:
    """(start, label, origin, path): for each node a label reaches, the shortest
    route to seeds of it, one row for each seed at the route's end; path is the
    array of (from_node, to_node, span) from the start on. Of equally short routes
    that over the first flows in order of (into, from, span), as a breadth-first
    search over sorted flows finds. Nodes without a name are not passed.

    flows: into, from, span; seeds: node, label, origin, span; names: node.
    """
    named = flows.join(names.select(F.col("node").alias("into")), "into", "left_semi").join(names.select(F.col("node").alias("from")), "from", "left_semi")
    own = seeds.join(names.select("node"), "node", "left_semi")
    dist = cut(distances(named, own))
    ahead = dist.select(F.col("node").alias("from"), "label", F.col("dist").alias("_d"))
    here = dist.select(F.col("node").alias("into"), "label", "dist")
    steps = named.join(ahead, "from").join(here, ["into", "label"]).where("_d = dist - 1")
    hop = cut(steps.groupBy("into", "label").agg(F.min(F.struct("from", "span")).alias("hop")).select(F.col("into").alias("at"), "label", "hop"))
    walk = dist.select(F.col("node").alias("start"), "label", F.col("node").alias("at"), "dist").withColumn("path", F.expr("cast(array() as array<struct<from_node:bigint,to_node:bigint,span:string>>)"))
    done = None
    for _ in range(10_000):
        ended = walk.where("dist = 0").select("start", "label", F.col("at").alias("node"), "path")
        done = ended if done is None else done.unionByName(ended)
        walk = walk.where("dist > 0")
        if walk.isEmpty():
            break
        edge = F.struct(F.col("at").cast("long").alias("from_node"), F.col("hop.from").cast("long").alias("to_node"), F.col("hop.span").cast("string").alias("span"))
        walk = cut(walk.join(hop, ["at", "label"]).select("start", "label", F.col("hop.from").alias("at"), (F.col("dist") - 1).alias("dist"), F.array_append("path", edge).alias("path")))
        done = cut(done)
    return done.join(own.select("node", "label", "origin", F.col("span").alias("origin_span")).distinct(), ["node", "label"]).select("start", "label", "node", "origin", "origin_span", "path")


def first_witness(all_: DataFrame) -> DataFrame:
    """One witness of each (start, label): the first seed in order."""
    return all_.groupBy("start", "label").agg(F.min_by(F.struct("node", "origin", "origin_span", "path"), F.struct("origin_span", "origin")).alias("w")).select("start", "label", "w.*")


def upward(callers: DataFrame, starts: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(start, node, dist, below): callers above each start, the start left out, with
    the fewest steps up and the node just below on that way, of equal ones the
    smallest. callers: callee, caller."""
    up = callers.select(F.col("callee").alias("node"), "caller").where("node <> caller").distinct()
    known = cut(starts.select(F.col("node").alias("start"), "node").distinct().withColumn("dist", F.lit(0)).withColumn("below", F.lit(None).cast("long")))
    new = known
    for i in range(1, max_rounds):
        step = new.join(up, "node").groupBy("start", F.col("caller").alias("_n")).agg(F.min("node").alias("below"))
        step = step.select("start", F.col("_n").alias("node"), F.lit(i).alias("dist"), F.col("below").cast("long"))
        new = cut(step.join(known, ["start", "node"], "left_anti"))
        if new.isEmpty():
            return known.where("dist > 0")
        known = cut(known.unionByName(new))
    raise RuntimeError("reach not settled")


def chain(above: DataFrame, ends: DataFrame) -> DataFrame:
    """(start, end, path): nodes from the end down to the start, along `below`."""
    walk = ends.select("start", "end", F.col("end").alias("at")).withColumn("path", F.array(F.col("end").cast("long")))
    links = above.select("start", F.col("node").alias("at"), "below")
    out = None
    for _ in range(10_000):
        reached = walk.where("at = start")
        out = reached if out is None else out.unionByName(reached)
        walk = walk.where("at <> start")
        if walk.isEmpty():
            return out.select("start", "end", "path")
        walk = cut(walk.join(links, ["start", "at"]).select("start", "end", F.col("below").alias("at"), F.array_append("path", F.col("below")).alias("path")))
    raise RuntimeError("chains not settled")
