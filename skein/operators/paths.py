"""Shortest chains of edges that explain a blast radius (G1h-G1j, U5), as frontier joins that carry the chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.loops import settle
from skein.operators.traverse import impact_edges, steps
from skein.schema import TERMINALS

# Kinds that a chain is told for while walking, and those that are looked for again from the first start.
WALK_GOALS = ("Table", "API", "External", "Service", "Event", "Test")
FAR_GOALS = ("Table", "API", "External", "Service", "Event")


def first_paths(walk: DataFrame, starts: DataFrame, max_depth: int | None = None, stop: DataFrame | None = None, goals: DataFrame | None = None) -> DataFrame:
    """(source, id, depth, path): of each id's shortest chains of edge ids from starts (source, id) the first in order.

    walk: (at, to, edge_id, start_only). stop (id) ends a walk. With goals (id) each round looks for them first, and the loop
    ends once every source has met all of them: the last round, which is the widest, goes to goals alone. Without max_depth
    it goes on while anything new is met. Each round is written."""
    front = settle(starts.select("source", "id", F.lit(0).alias("depth"), F.array().cast("array<string>").alias("path")).distinct())
    met, depth = front, 0
    wanted = settle(goals.select("id").distinct()) if goals is not None else None
    most = wanted.count() * starts.select("source").distinct().count() if wanted is not None else None
    got = met.join(wanted, "id", "left_semi").count() if wanted is not None else 0
    while max_depth is None or depth < max_depth:
        depth += 1
        live = front.join(stop.select("id"), "id", "left_anti") if stop is not None else front
        use = walk if depth == 1 else walk.where(~F.col("start_only"))
        if wanted is not None:
            near = settle(_next(live, use.join(wanted.select(F.col("id").alias("to")), "to", "left_semi"), met, depth))
            got += near.count()  # a source meets an id once
            if got == most:
                return met.unionByName(near)
        front = settle(_next(live, use, met, depth))
        if front.isEmpty():
            break
        met = met.unionByName(front)
    return met


def _next(live: DataFrame, walk: DataFrame, met: DataFrame, depth: int) -> DataFrame:
    nxt = live.select("source", F.col("id").alias("at"), "path").join(walk, "at").select("source", F.col("to").alias("id"), F.concat("path", F.array("edge_id")).alias("path"))
    nxt = nxt.groupBy("source", "id").agg(F.min("path").alias("path"))
    return nxt.join(met.select("source", "id"), ["source", "id"], "left_anti").select("source", "id", F.lit(depth).alias("depth"), "path")


def unique_paths(paths: DataFrame, max_paths: int | None = 7) -> DataFrame:
    """paths (source, id, depth, path), each chain of a source once, empty ones dropped; the first by length, then edges."""
    out = paths.where(F.size("path") > 0).groupBy("source", "path").agg(F.min("id").alias("id"), F.min("depth").alias("depth"))
    if max_paths is not None:
        out = out.withColumn("_r", F.row_number().over(Window.partitionBy("source").orderBy("depth", "path"))).where(F.col("_r") <= max_paths)
    return out.select("source", "id", "depth", "path")


def impact_paths(nodes: DataFrame, edges: DataFrame, starts: DataFrame, direction: str = "downstream", max_depth: int = 5, max_paths: int | None = 7) -> DataFrame:
    """(source, id, depth, path): a chain to each table, API, external, service, event and test that the walk meets."""
    walk = steps(nodes, edges, direction).select(F.col("src").alias("at"), F.col("dst").alias("to"), "edge_id", "start_only")
    stop = nodes.where(F.col("kind").isin(*TERMINALS)) if direction == "downstream" else None
    known = starts.join(nodes.select("id"), "id", "left_semi")
    met = first_paths(walk, known, max_depth, stop).where("depth > 0")
    return unique_paths(met.join(nodes.where(F.col("kind").isin(*WALK_GOALS)).select("id"), "id", "left_semi"), max_paths)


def shortest_paths(edges: DataFrame, starts: DataFrame, goals: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(source, id, depth, path) to each goal (id) over edges of all types, walked either way."""
    walk = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("id").alias("edge_id"))
    walk = walk.union(edges.where("src <> dst").select("dst", "src", "id")).withColumn("start_only", F.lit(False))
    met = first_paths(walk, starts, max_depth, goals=goals)
    return met.join(goals.select("id").distinct(), "id", "left_semi").select("source", "id", "depth", "path")


def single_steps(nodes: DataFrame, edges: DataFrame, met: DataFrame, paths: DataFrame) -> DataFrame:
    """(source, id, depth, path): for sources without a chain that reach anything but files and modules, their first edge."""
    far = met.where("depth > 0").join(nodes.where("kind not in ('File', 'Module')").select("id"), "id", "left_semi").select("source").distinct()
    bare = met.join(far, "source", "left_semi").join(paths.select("source").distinct(), "source", "left_anti")
    e = impact_edges(nodes, edges, bare)
    first = e.groupBy("source").agg(F.min(F.struct("depth", "edge_id", "to")).alias("f"))
    return first.select("source", F.col("f.to").alias("id"), F.lit(1).alias("depth"), F.array("f.edge_id").alias("path"))


def impact_why(nodes: DataFrame, edges: DataFrame, met: DataFrame, start: str, max_depth: int = 5, max_paths: int | None = 7) -> DataFrame:
    """All chains told for a blast radius met (source, id, depth) of one source: those of the walk, those found again
    from its first start, and a single edge where there are none; each once."""
    starts = met.where("depth = 0").select("source", "id")
    walked = impact_paths(nodes, edges, starts, max_depth=max_depth, max_paths=max_paths)
    goals = met.where("depth > 0").join(nodes.where(F.col("kind").isin(*FAR_GOALS)).select("id"), "id", "left_semi").orderBy("depth", "id").select("id")
    goals = settle(goals.limit(max_paths) if max_paths is not None else goals)
    again = shortest_paths(edges, starts.where(F.col("id") == start), goals)
    both = settle(unique_paths(walked.unionByName(again), max_paths))
    return both.unionByName(single_steps(nodes, edges, met, both))
