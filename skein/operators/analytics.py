"""Counts, degrees, insights, cycles, clusters, views and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators import traverse
from skein.operators.cyclic import strong_components
from skein.operators.loops import settle, sided
from skein.operators.store import dangling, ends, validate
from skein.schema import STRUCTURAL, SYMBOLS, UNSCORED, VIEWS

# With fewer nodes than this, a view shows code-level kinds, too.
FEW = 5
FEW_KINDS = ("Function", "Method", "Class", "Interface", "Module", "Package", "API", "Route", "Table", "External", "Service", "Repo", "Event", "Job", "Contract", "Test")


def degrees(edges: DataFrame, types=STRUCTURAL) -> DataFrame:
    """(id, n_in, n_out, total) of every end of edges of these types; a self-loop counts at both ends."""
    e = edges.where(F.col("type").isin(*types)) if types else edges
    ends = e.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(e.select(F.col("dst"), F.lit(1), F.lit(0)))
    return ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out")).withColumn("total", F.col("n_in") + F.col("n_out"))


def scored(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of scored kinds with a degree, and all symbols: (id, kind, name, n_in, n_out, total)."""
    d = nodes.where(~F.col("kind").isin(*UNSCORED)).join(degrees(edges).hint("merge"), "id", "left").fillna(0, ["n_in", "n_out", "total"])
    return d.where((F.col("total") > 0) | F.col("kind").isin(*SYMBOLS)).select("id", "kind", "name", "n_in", "n_out", "total")


def _top(df: DataFrame, score, limit: int | None) -> DataFrame:
    out = df.withColumn("score", score).orderBy(F.desc("score"), "name", "id")
    out = out.limit(limit) if limit is not None else out
    return out.select("id", "kind", "name", F.col("score").cast("long").alias("score"))


def highly_coupled(s: DataFrame, limit: int | None = 8) -> DataFrame:
    return _top(s.where("total >= 4"), F.col("total"), limit)


def bottlenecks(s: DataFrame, limit: int | None = 8) -> DataFrame:
    return _top(s.where("n_in >= 2 and n_out >= 2"), F.col("n_in") * F.col("n_out"), limit)


def hubs(s: DataFrame, limit: int | None = 8) -> DataFrame:
    return _top(s, F.col("total"), limit)


def isolated(s: DataFrame, limit: int | None = 8) -> DataFrame:
    """Symbols without a structural edge."""
    return _top(s.where(F.col("kind").isin(*SYMBOLS) & (F.col("total") == 0)), F.lit(0), limit)


def downstream_of_top(nodes: DataFrame, edges: DataFrame, candidates: int = 20, max_depth: int = 4, s: DataFrame | None = None) -> DataFrame:
    """(id, kind, name, total, downstream): how many nodes the most connected ones reach, in one loop for all. s: scored(), where it is known."""
    top = settle((scored(nodes, edges) if s is None else s).where("total > 0").orderBy(F.desc("total"), "name", "id").limit(candidates))
    met = traverse.impact(nodes, edges, top.select(F.col("id").alias("source"), "id"), "downstream", max_depth)
    n = met.groupBy("source").agg((F.count("*") - 1).alias("downstream")).withColumnRenamed("source", "id")
    return sided(top, candidates).join(n, "id").select("id", "kind", "name", "total", "downstream")


def large_downstream(d: DataFrame, limit: int | None = 8) -> DataFrame:
    return _top(d.where("downstream >= 3"), F.col("downstream"), limit)


def hotspots(d: DataFrame, limit: int | None = 8) -> DataFrame:
    return _top(d.where("downstream >= 5 or (total >= 6 and downstream >= 2)"), F.col("downstream") + F.col("total"), limit)


def most_connected(nodes: DataFrame, edges: DataFrame, limit: int = 5) -> DataFrame:
    """By all edges; a self-loop counts twice."""
    return _top(nodes.join(degrees(edges, None), "id"), F.col("total"), limit)


def _cyclic_edges(edges: DataFrame, types) -> DataFrame:
    """Distinct edges (src, dst, component) of the types whose ends lie in the same strongly connected component."""
    e = edges.where(F.col("type").isin(*types)).select("src", "dst")
    comp = strong_components(e)
    end = lambda c: comp.select(F.col("id").alias(c), F.col("component").alias(f"_{c}"))
    return settle(e.where("src <> dst").distinct().join(end("src"), "src").join(end("dst"), "dst").where("_src = _dst").select("src", "dst", F.col("_src").alias("component")))


def cycle_members(edges: DataFrame, max_length: int | None = None, types=("CALLS", "IMPORTS", "DEPENDS_ON")) -> DataFrame:
    """(id, length): nodes on a cycle (two nodes at least, max_length edges at most), with its smallest length.

    A component with as many edges as nodes is a ring: its size is the length of all its nodes, and nothing is walked. In
    others walks stay inside the component; without max_length they end when each has met all of its own."""
    every = _cyclic_edges(edges, types)
    size = settle(every.groupBy("component").agg(F.count("*").alias("n"), F.count_distinct("src").alias("length")).where("n = length"))
    rings = every.join(size, "component").select(F.col("src").alias("id"), F.col("length").cast("int").alias("length"))
    rings = rings.where(F.col("length") <= max_length) if max_length is not None else rings
    e = settle(every.join(size.select("component"), "component", "left_anti").select("src", "dst"))
    if e.isEmpty():
        return rings
    met = e.select(F.col("src").alias("start"), F.col("dst").alias("id"), F.lit(1).alias("length"))
    front, d = met, 1
    while max_length is None or d < max_length:
        d += 1
        nxt = front.where("id <> start").select("start", F.col("id").alias("src")).join(e, "src").select("start", F.col("dst").alias("id")).distinct()
        front = settle(nxt.join(met.select("start", "id"), ["start", "id"], "left_anti").withColumn("length", F.lit(d)))
        if front.isEmpty():
            break
        met = met.unionByName(front.select("start", "id", "length"))
    return met.where("start = id").groupBy("id").agg(F.min("length").alias("length")).unionByName(rings)


def cycles(edges: DataFrame, max_length: int | None = None, limit: int | None = 12, types=("CALLS", "IMPORTS", "DEPENDS_ON")) -> DataFrame:
    """(length, path): simple cycles, each once, beginning with its smallest id; shortest first.

    Paths grow inside a component only. Without max_length and limit all simple cycles are listed, of which a dense component
    has very many; with a limit the rounds end once that many are found."""
    e = _cyclic_edges(edges, types).select("src", "dst")
    front, found, d = e.where("src < dst").select(F.array("src", "dst").alias("path")), None, 1
    while max_length is None or d < max_length:
        d += 1
        step = front.withColumn("src", F.element_at("path", -1)).join(e, "src")
        closed = settle(step.where(F.col("dst") == F.col("path")[0]).select(F.lit(d).alias("length"), "path"))
        found = closed if found is None else found.unionByName(closed)
        front = settle(step.where((F.col("dst") > F.col("path")[0]) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path")))
        if front.isEmpty() or (limit is not None and found.limit(limit).count() >= limit):
            break
    out = found.orderBy("length", "path")
    return out.limit(limit) if limit is not None else out


def orphans(nodes: DataFrame, edges: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """Nodes at no edge. met: ends(edges), where they are known."""
    return nodes.join((ends(edges) if met is None else met).hint("merge"), "id", "left_anti")


def clusters(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members for each directory, and edges between directories: (a, b, n, type of the first edge by id)."""
    own = nodes.select("id", F.coalesce("path", F.concat(F.lit("("), "kind", F.lit(")"))).alias("cluster"))
    size = own.groupBy("cluster").agg(F.count("*").alias("members"))
    e = edges.where("type <> 'CONTAINS'").join(own.select(F.col("id").alias("src"), F.col("cluster").alias("a")), "src").join(own.select(F.col("id").alias("dst"), F.col("cluster").alias("b")), "dst").where("a <> b")
    return size, e.groupBy("a", "b").agg(F.count("*").alias("n"), F.min_by("type", "id").alias("type"))


def view(nodes: DataFrame, edges: DataFrame, mode: str = "height", max_nodes: int | None = 250) -> tuple[DataFrame, DataFrame]:
    """Nodes of the mode's kinds (by kind and name, cut at max_nodes) and the mode's edges among them.

    A graph with fewer than FEW such nodes shows those of FEW_KINDS, 200 at most where there is a cut."""
    kinds, types = VIEWS[mode]
    n = nodes.where(F.col("kind").isin(*kinds))
    if n.limit(FEW).count() < FEW:
        n, max_nodes = nodes.where(F.col("kind").isin(*FEW_KINDS)), max_nodes and min(200, max_nodes)
    n = n.orderBy("kind", "name", "id")
    n = settle(n.limit(max_nodes)) if max_nodes else n
    ids = sided(n.select("id"), n.count())
    e = edges.where(F.col("type").isin(*types)) if types else edges
    return n, e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def mermaid(nodes: DataFrame, edges: DataFrame, max_edges: int = 200, max_nodes: int = 40) -> DataFrame:
    """One row, text: a flow chart of the first edges, or of the first nodes where there are none."""
    safe = lambda c: F.substring(F.regexp_replace(c, "[^A-Za-z0-9_]", "_"), 1, 48)
    label = lambda c: F.substring(F.regexp_replace(c, r'["\[\]]', ""), 1, 40)
    names = nodes.select("id", "name")
    e = edges.orderBy("id").limit(max_edges).join(names.select(F.col("id").alias("src"), F.col("name").alias("a")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst")
    lines = e.select("id", F.concat(F.lit("  "), safe(F.col("src")), F.lit('["'), label(F.col("a")), F.lit('"] -->|'), "type", F.lit("| "), safe(F.col("dst")), F.lit('["'), label(F.col("b")), F.lit('"]')).alias("line"))
    alone = nodes.orderBy("name", "id").limit(max_nodes).select("id", F.concat(F.lit("  "), safe(F.col("id")), F.lit('["'), label(F.col("name")), F.lit('"]')).alias("line"))
    alone = alone.join(edges.limit(1).select(F.lit(1).alias("_x")), how="left_anti", on=F.lit(True))
    body = lines.unionByName(alone).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n").alias("b"))
    return body.select(F.concat(F.lit("flowchart LR\n"), "b").alias("text"))


def policies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(policy, node_id): exposing APIs without a contract of their path, and critical nodes that nothing tests."""
    contracts = nodes.where("kind = 'Contract' and path is not null").select("path").hint("merge")
    api = nodes.where("kind in ('API', 'Route') and path is not null").join(edges.where("type = 'EXPOSES'").select(F.col("src").alias("id")).hint("merge"), "id", "left_semi").join(contracts, "path", "left_anti")
    bare = nodes.where(F.array_contains("tags", "critical")).join(edges.where("type = 'TESTS'").select(F.col("dst").alias("id")).hint("merge"), "id", "left_anti")
    return api.select(F.lit("public-api-requires-contract").alias("policy"), F.col("id").alias("node_id")).unionByName(bare.select(F.lit("critical-must-have-tests").alias("policy"), F.col("id").alias("node_id")))


def health(nodes: DataFrame, edges: DataFrame, met: DataFrame | None = None, bad: DataFrame | None = None) -> DataFrame:
    """(category, item, n): sizes, problems, edges by type, orphans and nodes by kind. met: ends(edges), bad: dangling(), where they are known."""
    one = lambda df, category, item: df.agg(F.count("*").alias("n")).select(F.lit(category).alias("category"), F.lit(item).alias("item"), "n")
    by = lambda df, category, key: df.groupBy(F.col(key).alias("item")).agg(F.count("*").alias("n")).select(F.lit(category).alias("category"), "item", "n")
    types = edges.where(F.col("type").isin("CONTAINS", "IMPORTS", "CALLS", "EXPOSES", "CONSUMES", "READS", "WRITES", "TESTS", "DEPENDS_ON", "DOCUMENTS", "CO_CHANGED"))
    kinds = nodes.where(F.col("kind").isin("Service", "Function", "API", "Table", "Test", "External", "Class"))
    return one(nodes, "graph", "nodes").unionByName(one(edges, "graph", "edges")).unionByName(one(validate(nodes, edges, bad), "validation", "errors")).unionByName(by(types, "edges", "type")).unionByName(one(orphans(nodes, edges, met), "orphans", "nodes")).unionByName(by(kinds, "coverage", "kind"))


def verify(nodes: DataFrame, edges: DataFrame, allowed: DataFrame | None = None, touched: DataFrame | None = None, bad: DataFrame | None = None) -> DataFrame:
    """(name, passed, message): a valid graph, not empty, and touched files (path) inside allowed ones (path). bad: dangling(), where it is known."""
    n = nodes.agg(F.count("*").alias("n"))
    bad = (dangling(nodes, edges) if bad is None else bad).agg(F.count("*").alias("n"))
    out = n.select(F.lit("not_empty").alias("name"), (F.col("n") > 0).alias("passed"), F.concat(F.col("n").cast("string"), F.lit(" nodes")).alias("message"))
    out = out.unionByName(bad.select(F.lit("no_dangling").alias("name"), (F.col("n") == 0).alias("passed"), F.concat(F.col("n").cast("string"), F.lit(" dangling edges")).alias("message")))
    if allowed is not None and touched is not None:
        a = allowed.select(F.col("path").alias("a"))
        outside = touched.join(a, (F.col("path") == F.col("a")) | F.endswith("path", "a") | F.contains("path", F.concat(F.lit("/"), "a")), "left_anti")
        out = out.unionByName(outside.agg(F.count("*").alias("n")).select(F.lit("inside_plan").alias("name"), (F.col("n") == 0).alias("passed"), F.concat(F.col("n").cast("string"), F.lit(" files outside")).alias("message")))
    return out


def explain_node(edges: DataFrame, id_: str) -> DataFrame:
    """One row: how many callers, callees, reads, writes, APIs and tests a node has."""
    n = lambda cond, name: F.count(F.when(F.expr(cond), 1)).alias(name)
    lit = id_.replace("'", "\\'")
    e = edges.where((F.col("src") == id_) | (F.col("dst") == id_))
    return e.agg(n(f"type='CALLS' and dst='{lit}'", "callers"), n(f"type='CALLS' and src='{lit}'", "callees"), n(f"type='READS' and src='{lit}'", "reads"), n(f"type='WRITES' and src='{lit}'", "writes"), n(f"type='EXPOSES' and src='{lit}'", "apis"), n(f"type='TESTS' and dst='{lit}'", "tests"))


def plan_files(reported: DataFrame) -> DataFrame:
    """(path): files that a change may touch, from its blast radius."""
    return reported.where("path is not null and (depth = 0 or kind in ('Function', 'Method', 'Class', 'File', 'Test'))").select("path").distinct()


def debate(proposals: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, present, missing, score): graph ids cited by each proposal (title, body); a missing one costs two."""
    cited = F.regexp_extract_all(F.concat_ws(" ", "body", "title"), F.lit(r"\b((?:fn|api|table|svc|cls|file|ext):[^\s]+)"), 1)
    c = proposals.select("id", F.explode_outer(cited).alias("node_id"))
    j = c.join(nodes.select(F.col("id").alias("node_id"), F.lit(1).alias("_ok")), "node_id", "left")
    out = j.groupBy("id").agg(F.count("_ok").alias("present"), F.count(F.when(F.col("node_id").isNotNull() & F.col("_ok").isNull(), 1)).alias("missing"))
    return out.withColumn("score", F.col("present") - 2 * F.col("missing"))


def identify_services(files: DataFrame) -> DataFrame:
    """(service_id, name, bucket, files) from paths below apps, services, packages or src."""
    pattern = r"^(apps|services|packages|src)/([^/]+)/"
    d = files.where(F.rlike("path", F.lit(pattern)))
    d = d.select(F.regexp_extract("path", pattern, 2).alias("name"), F.concat_ws("/", F.regexp_extract("path", pattern, 1), F.regexp_extract("path", pattern, 2)).alias("bucket"))
    return d.groupBy("name", "bucket").agg(F.count("*").alias("files")).select(F.concat(F.lit("svc:"), "name").alias("service_id"), "name", "bucket", "files")


def rank_in(df: DataFrame, by: str, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
