"""Strongly connected components and the cycles inside them, of any length.

1. Nodes without a way in or out are peeled, a bounded number of rounds: what chains remain cost nothing in step 2.
2. Nodes with one way in and one out are passed over: pointers along them double with each round, so that a chain of n nodes takes
   log2(n) rounds. A chain becomes one edge between its ends, and its nodes are in a component if both ends are in the same one.
   A ring of such nodes alone is a component. Both steps repeat while they shrink the graph by a tenth.
3. What is left is coloured: every node takes the largest id that reaches it; from a node that kept its own id its colour is
   walked back, and what is met is its component. Rounds grow with the depth of the graph that steps 1 and 2 leave.

Each round is a join or an aggregate on nodes and is written; the rounds before are deleted. No node's neighbours ever meet in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.loops import drop_settled, settle

PEELS = 3


def _swap(df: DataFrame, new: DataFrame) -> DataFrame:
    """new, written; what df held is deleted."""
    out = settle(new)
    drop_settled(df)
    return out


def peel(e: DataFrame, rounds: int = PEELS) -> DataFrame:
    """Edges (src, dst) between nodes that have both a way in and a way out, after some rounds."""
    for _ in range(rounds):
        e = _swap(e, e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
    return e


def _ends(step: DataFrame) -> DataFrame:
    """step (v, to) of passed nodes, to a next node: (v, to, low, open) with the first node that is not passed; those of rings stay open, low is their smallest id."""
    passed = step.select(F.col("v").alias("to"))
    held = settle(step.join(passed.withColumn("open", F.lit(True)), "to", "left").select("v", "to", F.col("v").alias("low"), F.coalesce("open", F.lit(False)).alias("open")))
    left = -1
    while True:
        ahead = held.select(F.col("v").alias("to"), F.col("to").alias("_to"), F.col("low").alias("_low"), F.col("open").alias("_open"))
        nxt = held.where("open").join(ahead, "to").select("v", F.col("_to").alias("to"), F.least("low", "_low").alias("low"), F.col("_open").alias("open"), (F.col("_low") < F.col("low")).alias("moved"))
        held = _swap(held, held.where("not open").select("v", "to", "low", "open", F.lit(False).alias("moved")).unionByName(nxt))
        n, moving = held.where("open").agg(F.count("*"), F.coalesce(F.max(F.col("moved").cast("int")), F.lit(0))).first()
        if n == left and not moving or n == 0:
            return held
        left = n


def contract(e: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, chains, rings): edges without passed nodes, (v, first, last) of those between two others, (v, component) of rings."""
    ways = e.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("n")).where("n = 1").select("v").join(e.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("n")).where("n = 1").select("v"), "v")
    one = settle(ways)
    on = _ends(settle(e.join(one.withColumnRenamed("v", "src"), "src", "left_semi").select(F.col("src").alias("v"), F.col("dst").alias("to"))))
    back = _ends(settle(e.join(one.withColumnRenamed("v", "dst"), "dst", "left_semi").select(F.col("dst").alias("v"), F.col("src").alias("to"))))
    rings = settle(on.where("open").select("v", F.col("low").alias("component")))
    chains = settle(on.where("not open").select("v", F.col("to").alias("last")).join(back.select("v", F.col("to").alias("first")), "v").select("v", "first", "last"))
    kept = e.join(one.withColumnRenamed("v", "src"), "src", "left_anti").join(one.withColumnRenamed("v", "dst"), "dst", "left_anti")
    out = settle(kept.unionByName(chains.select(F.col("first").alias("src"), F.col("last").alias("dst"))).distinct())
    drop_settled(one, on, back)
    return out, chains, rings


def _colour(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, rest) of edges without loops: (id, component) of every component that a colour's own node lies in, and the edges still open."""
    node = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    colour = settle(node.select("id", F.col("id").alias("c"), F.lit(True).alias("new")))
    while True:
        sent = colour.where("new").select(F.col("id").alias("src"), "c").join(e, "src").groupBy(F.col("dst").alias("id")).agg(F.max("c").alias("m"))
        colour = _swap(colour, colour.join(sent, "id", "left").select("id", F.greatest("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") > F.col("c")).alias("new")))
        if colour.where("new").isEmpty():
            break
    of = colour.select("id", "c")
    inner = settle(e.join(of.select(F.col("id").alias("src"), "c"), "src").join(of.select(F.col("id").alias("dst"), F.col("c").alias("d")), "dst").where("c = d").select("src", "dst", "c"))
    met = settle(of.where("id = c").withColumn("new", F.lit(True)))
    while True:
        nxt = met.where("new").select(F.col("id").alias("dst"), "c").join(inner, ["dst", "c"]).select(F.col("src").alias("id"), "c").distinct()
        met = _swap(met, met.select("id", "c", F.lit(False).alias("new")).unionByName(nxt.join(met, ["id", "c"], "left_anti").withColumn("new", F.lit(True))))
        if met.where("new").isEmpty():
            break
    found = settle(met.select("id", F.col("c").alias("component")))
    rest = inner.select("src", "dst").join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti")
    rest = settle(rest)
    drop_settled(colour, inner, met)
    return found, rest


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component, size) of the nodes of edges (src, dst) that lie on a cycle of two nodes or more; component is its smallest id.

    Null ends and self-loops are no edges, repeated edges count once. No cycles: no rows."""
    e = settle(edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct())
    levels, pieces = [], []
    while True:
        before = e.count()
        if not before:
            break
        e = peel(e)
        short, chains, rings = contract(e)
        pieces.append(rings.withColumnRenamed("v", "id"))
        drop_settled(e)
        e = settle(short.where("src <> dst"))
        loops = settle(short.where("src = dst").select(F.col("src").alias("id"), F.col("src").alias("component")))
        levels.append((chains, loops))  # a chain from a node to itself makes a component of both, if the node is in no other
        drop_settled(short)
        if e.count() > 0.9 * before:
            break
    while not e.isEmpty():
        found, rest = _colour(e)
        pieces.append(found)
        drop_settled(e)
        e = peel(rest)
    if not pieces:
        return e.select(F.col("src").alias("id"), F.col("src").alias("component"), F.lit(0).cast("long").alias("size"))
    comp = pieces[0]
    for p in pieces[1:]:
        comp = comp.unionByName(p)
    comp = settle(comp)
    for chains, loops in reversed(levels):  # ends are known before what lies between them
        comp = _swap(comp, comp.unionByName(loops.join(comp, "id", "left_anti")))
        first = comp.select(F.col("id").alias("first"), "component")
        last = comp.select(F.col("id").alias("last"), F.col("component").alias("_c"))
        inside = chains.join(first, "first").join(last, "last").where("component = _c").select(F.col("v").alias("id"), "component")
        comp = _swap(comp, comp.unionByName(inside))
    named = comp.groupBy("component").agg(F.min("id").alias("low"), F.count("*").alias("size")).where("size > 1")
    out = settle(comp.join(named, "component").select("id", F.col("low").alias("component"), "size"))
    drop_settled(comp, e, *pieces, *(f for level in levels for f in level))
    return out
