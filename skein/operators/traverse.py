"""Bounded traversals as frontier-join loops (G1-G4, G11). A frontier holds (source, id), so that many starts share one loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.loops import settle, sided
from skein.schema import FLOW_PRIORITY, RELATIONAL, TERMINALS


def steps(nodes: DataFrame, edges: DataFrame, direction: str = "downstream", starts: DataFrame | None = None) -> DataFrame:
    """(src, dst, edge_id, type, start_only): where an expanded node src leads. With starts (id, a side of a join) what is
    followed from starts alone is told of these only, before its far ends meet the nodes."""
    if direction == "upstream":
        return edges.where(F.col("type").isin("CALLS", "IMPORTS", "READS", "CONSUMES", "DEPENDS_ON")).select("src", "dst", F.col("id").alias("edge_id"), "type", F.lit(False).alias("start_only"))
    out = edges.where("type = 'EXPOSES'").select("src", "dst", F.col("id").alias("edge_id"), "type", F.lit(False).alias("start_only"))
    into = edges.where(F.col("type").isin("CALLS", "CONSUMES", "SUBSCRIBES", "TESTS")).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("id").alias("edge_id"), "type", F.lit(False).alias("start_only"))
    own = edges.join(starts.withColumnRenamed("id", "src"), "src", "left_semi") if starts is not None else edges
    writes = own.where(F.col("type").isin("WRITES", "PUBLISHES")).select("src", "dst", F.col("id").alias("edge_id"), "type", F.lit(True).alias("start_only"))
    far = nodes.where(F.col("kind").isin("External", "API", "Event")).select(F.col("id").alias("dst"))
    far = far.hint("merge") if starts is not None else far
    calls = own.where("type = 'CALLS'").join(far, "dst", "left_semi").select("src", "dst", F.col("id").alias("edge_id"), "type", F.lit(True).alias("start_only"))
    return out.unionByName(into).unionByName(writes).unionByName(calls)


def _live(front: DataFrame, rows: int, stop: DataFrame | None) -> DataFrame:
    """front (id, ...), of this many rows at most, without ids in stop (id): of stop those alone that front has come back to it."""
    if stop is None:
        return front
    ended = stop.join(sided(front.select("id"), rows), "id", "left_semi")
    return front.join(sided(ended, rows), "id", "left_anti")


def _leading(st: DataFrame, goals: DataFrame, stop: DataFrame | None, max_depth: int) -> list[tuple[DataFrame, int]]:
    """For each depth from 0 to max_depth the ids (id) from which a goal (id) is met in the rounds that are left, and their number."""
    use = st.where(~F.col("start_only"))
    front = settle(goals.select("id").distinct())
    ways = [(front, front.count())]
    for left in range(1, max_depth + 1):
        back = (use if left < max_depth else st).select("src", F.col("dst").alias("id")).join(sided(*ways[-1]), "id", "left_semi").select(F.col("src").alias("id")).distinct()
        back = back.join(stop.hint("merge"), "id", "left_anti") if stop is not None else back
        front = settle(back.union(front).distinct())
        ways.append((front, front.count()))
    return ways[::-1]


def reach(nodes: DataFrame, edges: DataFrame, starts: DataFrame, direction: str = "downstream", max_depth: int = 5, goals: DataFrame | None = None) -> DataFrame:
    """(source, id, depth) of every id met from starts (source, id) within max_depth; unknown starts are ignored.

    Ids without a node are met and expanded too. Downstream, External, Table and Test end a walk, even at its start.
    Each round joins the frontier with the steps on their source, drops what was met before, and is written; the steps are
    read from the edges anew. With goals (id) only these are returned, and only what leads to one in the rounds left is
    followed: what many starts meet alike, and leads nowhere, is not met once for each of them."""
    stop = nodes.where(F.col("kind").isin(*TERMINALS)).select("id") if direction == "downstream" else None
    first = settle(starts.select("source", "id").distinct())
    n = first.count()
    known = nodes.select("id").join(sided(first.select("id"), n), "id", "left_semi")
    front = settle(first.join(sided(known, n), "id", "left_semi").select("source", "id", F.lit(0).alias("depth")))
    st = steps(nodes, edges, direction, sided(front.select("id"), n))
    ways = _leading(st, goals, stop, max_depth) if goals is not None else None
    front = settle(front.join(sided(*ways[0]), "id", "left_semi").select(front.columns)) if ways else front
    met, n = front, front.count()
    seen = n
    for depth in range(max_depth):
        live = _live(front, n, stop)
        use = st if depth == 0 else st.where(~F.col("start_only"))
        use = use.select("src", F.col("dst").alias("id"))
        use = use.join(sided(*ways[depth + 1]), "id", "left_semi") if ways else use
        nxt = sided(live.select("source", F.col("id").alias("src")), n).join(use, "src").select("source", "id").distinct()
        front = settle(nxt.join(sided(met.select("source", "id"), seen), ["source", "id"], "left_anti").withColumn("depth", F.lit(depth + 1)))
        n = front.count()
        if n == 0:
            break
        met, seen = met.unionByName(front), seen + n
    return met.join(sided(*ways[-1]), "id", "left_semi").select("source", "id", "depth") if ways else met


def one_start(spark, id_: str) -> DataFrame:
    return spark.createDataFrame([(id_, id_)], "source string, id string")


def reported(nodes: DataFrame, met: DataFrame) -> DataFrame:
    """What was met, with its nodes' columns; ids without a node are left out."""
    return sided(met, met.count()).join(nodes, "id")


def impact(nodes: DataFrame, edges: DataFrame, starts: DataFrame, direction: str = "downstream", max_depth: int = 5, kind: str | None = None) -> DataFrame:
    """(source, id, kind, name, path, tags, depth): the nodes of the blast radius, or those of one kind in it."""
    goals = nodes.where(F.col("kind") == kind) if kind is not None else None
    met = reach(nodes, edges, starts, direction, max_depth, goals)
    return met.join(sided(goals, goals.count()), "id") if goals is not None else reported(nodes, met)


def impact_edges(nodes: DataFrame, edges: DataFrame, met: DataFrame, direction: str = "downstream") -> DataFrame:
    """(source, edge_id, type, at, to, to_kind, depth): the relevant edges of every expanded id, those at the last depth included."""
    n = met.count()
    st = steps(nodes, edges, direction, sided(met.where("depth = 0").select("id"), n))
    live = _live(met, n, nodes.where(F.col("kind").isin(*TERMINALS)).select("id") if direction == "downstream" else None)
    e = sided(live.select("source", F.col("id").alias("src"), "depth"), n).join(st, "src").where((F.col("depth") == 0) | ~F.col("start_only"))
    e = settle(e.dropDuplicates(["source", "src", "edge_id"]).drop("start_only"))
    n = e.count()
    known = nodes.join(sided(e.select(F.col("dst").alias("id")).distinct(), n), "id", "left_semi")  # of the nodes those alone that an edge ends at
    return e.join(sided(known.select(F.col("id").alias("dst"), F.col("kind").alias("to_kind"), F.col("name").alias("to_name"), F.col("tags").alias("to_tags")), n), "dst", "left").select("source", "edge_id", "type", F.col("src").alias("at"), F.col("dst").alias("to"), "to_kind", "to_name", "depth")


def impact_risks(nodes: DataFrame, edges: DataFrame, met: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """(source, kind, node_id): critical nodes met; tables written and externals called by what was met; conflicting
    edges among them (ids in conflicts); starts that are functions and that no test met covers."""
    e = impact_edges(nodes, edges, met)
    told = reported(nodes.select("id", "kind", "tags"), met)
    out = told.where(F.array_contains("tags", "critical")).select("source", F.lit("critical").alias("kind"), F.col("id").alias("node_id"))
    # chips arise at first meetings: an edge back to what was met at the same depth or before has none
    seen = met.select("source", F.col("id").alias("to"), F.col("depth").alias("_at"))
    e = settle(e.join(sided(seen, met.count()), ["source", "to"], "left").where("_at is null or _at > depth"))
    out = out.unionByName(e.where("type = 'WRITES'").select("source", F.lit("db_write").alias("kind"), F.col("to").alias("node_id")))
    out = out.unionByName(e.where("to_kind = 'External'").select("source", F.lit("external").alias("kind"), F.col("to").alias("node_id")))
    if conflicts is not None:
        out = out.unionByName(e.join(conflicts.select(F.col("id").alias("edge_id")), "edge_id", "left_semi").select("source", F.lit("conflict").alias("kind"), F.col("to").alias("node_id")))
    tested = edges.where("type = 'TESTS'").select(F.col("dst").alias("id")).distinct().hint("merge")
    bare = told.where("depth = 0 and kind in ('Function', 'Method')").join(tested, "id", "left_anti")
    return out.unionByName(bare.select("source", F.lit("untested").alias("kind"), F.col("id").alias("node_id"))).distinct()


def severity(reported: DataFrame, risks: DataFrame) -> DataFrame:
    """(source, affected, severity): affected leaves out starts and files."""
    n = reported.groupBy("source").agg(F.count(F.when((F.col("depth") > 0) & (F.col("kind") != "File"), 1)).alias("affected"))
    r = risks.groupBy("source").agg(F.bool_or(F.col("kind").isin("critical", "conflict")).alias("bad"), F.bool_or(F.col("kind").isin("untested", "db_write", "external")).alias("some"))
    j = n.join(r, "source", "left")
    level = F.when(F.coalesce("bad", F.lit(False)) | (F.col("affected") > 10), "critical").when(F.coalesce("some", F.lit(False)) | (F.col("affected") > 3), "medium").otherwise("low")
    return j.select("source", "affected", level.alias("severity"))


def why_paths(nodes: DataFrame, edges: DataFrame, start: str, goal: str, max_depth: int = 5, max_paths: int | None = 7) -> DataFrame:
    """(length, path): chains of edge ids between two nodes over relational edges, walked either way.

    An edge serves once in a path; a node may be entered again up to two hops after it was first seen. Shortest
    paths first, then by their edges."""
    e = edges.where(F.col("type").isin(*RELATIONAL))
    walk = settle(e.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("id").alias("edge_id")).union(e.where("src <> dst").select("dst", "src", "id")))
    spark = nodes.sparkSession
    if start == goal:
        return spark.createDataFrame([], "length int, path array<string>")
    front = spark.createDataFrame([(start, [])], "at string, used array<string>")
    seen = spark.createDataFrame([(start, 0)], "to string, first int")
    found = spark.createDataFrame([], "length int, path array<string>")
    for depth in range(1, max_depth + 1):
        nxt = front.join(walk, "at").where(~F.array_contains("used", F.col("edge_id"))).select("to", F.concat("used", F.array("edge_id")).alias("used"))
        nxt = nxt.join(seen, "to", "left").where(F.col("first").isNull() | (F.lit(depth) <= F.col("first") + 2))
        nxt = settle(nxt.select("to", "used", F.coalesce("first", F.lit(depth)).alias("first")))
        seen = settle(seen.unionByName(nxt.select("to", "first")).groupBy("to").agg(F.min("first").alias("first")))
        found = found.unionByName(nxt.where(F.col("to") == goal).select(F.lit(depth).alias("length"), F.col("used").alias("path")))
        front = nxt.where(F.col("to") != goal).select(F.col("to").alias("at"), "used")
        if max_paths is not None and found.limit(max_paths).count() >= max_paths:
            break
    out = found.orderBy("length", "path")
    return out.limit(max_paths) if max_paths is not None else out


def next_hops(edges: DataFrame) -> DataFrame:
    """(src, dst, type): from each node the edge of the first type by priority, smallest id among equals."""
    rank = F.lit(None).cast("int")
    for i, t in reversed(list(enumerate(FLOW_PRIORITY))):
        rank = F.when(F.col("type") == t, i).otherwise(rank)
    e = edges.where(F.col("type").isin(*FLOW_PRIORITY)).withColumn("_r", rank)
    return e.groupBy("src").agg(F.min_by(F.struct("dst", "type"), F.struct("_r", "id")).alias("e")).select("src", "e.dst", "e.type")


def flow(nodes: DataFrame, edges: DataFrame, start: str, max_steps: int = 10) -> DataFrame:
    """(step_no, node_id, label, edge_type): the greedy walk; it stops at a revisit, a missing node or max_steps."""
    hops = settle(next_hops(edges))
    known = nodes.select("id", "kind", "name")
    at, rows = start, []
    for i in range(max_steps):
        if at in [r[1] for r in rows]:
            break
        node = known.where(F.col("id") == at).first()
        if node is None:
            break
        hop = hops.where(F.col("src") == at).first()
        rows.append((i + 1, at, f"{node['kind']}: {node['name']}", hop["type"] if hop else None))
        if hop is None:
            break
        at = hop["dst"]
    return nodes.sparkSession.createDataFrame(rows, "step_no int, node_id string, label string, edge_type string")


def depth_view(nodes: DataFrame, edges: DataFrame, focus: str, max_depth: int = 3, max_nodes: int | None = None) -> DataFrame:
    """(id, depth): undirected neighbourhood of a node, not through CONTAINS to another file."""
    files = nodes.where("kind = 'File'").select(F.col("id").alias("to"), F.lit(True).alias("_file"))
    both = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), "type").union(edges.select(F.col("dst"), F.col("src"), "type"))
    both = settle(both.join(files, "to", "left").where("not (type = 'CONTAINS' and _file is not null)").select("at", "to").distinct())
    met = settle(nodes.where(F.col("id") == focus).select("id", F.lit(0).alias("depth")))
    front = met
    for d in range(1, max_depth + 1):
        nxt = front.select(F.col("id").alias("at")).join(both, "at").select(F.col("to").alias("id")).distinct()
        front = settle(nxt.join(met.select("id"), "id", "left_anti").join(nodes.select("id"), "id", "left_semi").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        met = met.unionByName(front)
    return met.orderBy("depth", "id").limit(max_nodes) if max_nodes else met
