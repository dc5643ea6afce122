"""The graph store: ordered folds, merges, deletions, look-ups, neighbours and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.ids import edge_id, fold_ascii
from skein.operators.loops import settle, sided


def fold_nodes(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """The last row of each id by seq. max_by is combined before the shuffle, so a hot id costs one row a task."""
    cols = [c for c in rows.columns if c not in ("id", seq)]
    last = F.max_by(F.struct(*cols), F.struct(seq, *[F.col(c) for c in cols if dict(rows.dtypes)[c] != "map<string,string>"])).alias("r")
    return rows.groupBy("id").agg(last).select("id", "r.*")


def fold_edges(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """All occurrences of each edge id, in the order of seq, as one edge.

    The first is stored as it is. Later ones without conflict add evidence (first of each file:line), sources and
    the larger confidence; one with conflict replaces these three. type, metadata and updated_at come from the last,
    src and dst from the first; conflict, once set, stays."""
    extra = [c for c in ("metadata", "updated_at") if c in rows.columns]
    w = Window.partitionBy("id").orderBy(seq)
    d = rows.withColumn("_n", F.row_number().over(w))
    d = d.withColumn("_from", F.max(F.when(F.col("conflict") & (F.col("_n") > 1), F.col("_n"))).over(Window.partitionBy("id")))
    d = d.withColumn("_from", F.coalesce("_from", F.lit(1)))
    late = F.col("_n") >= F.col("_from")
    d = d.withColumn("_late", late).withColumn("_items", F.count(F.when(late, 1)).over(Window.partitionBy("id")))
    agg = d.groupBy("id").agg(
        F.max_by("type", "_n").alias("type"), F.min_by("src", "_n").alias("src"), F.min_by("dst", "_n").alias("dst"),
        F.max(F.when(F.col("_late"), F.col("confidence"))).alias("confidence"), F.bool_or("conflict").alias("conflict"),
        *(F.max_by(c, "_n").alias(c) for c in extra),
    )
    out = agg
    for name, key in (("evidence", F.concat_ws(":", F.col("x.file"), F.col("x.line").cast("string"))), ("sources", F.col("x"))):
        out = out.join(_firsts(d, name, key), "id", "left")
    empty = {n: F.array().cast(dict(rows.dtypes)[n]) for n in ("evidence", "sources")}
    return out.select(*agg.columns, *(F.coalesce(n, e).alias(n) for n, e in empty.items()))


def _firsts(d: DataFrame, name: str, key) -> DataFrame:
    """(id, name): the first item of each key in the array column, in order; all items of an edge folded from one row."""
    items = d.where("_late").select("id", "_n", "_items", F.posexplode(name).alias("at", "x"))
    by = F.when(F.col("_items") > 1, key).otherwise(F.concat_ws("|", "_n", "at"))
    place = F.struct("_n", "at")
    first = items.groupBy("id", by.alias("k")).agg(F.min(place).alias("place"), F.min_by("x", place).alias("x"))
    return first.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda y: y["x"]).alias(name))


def with_edge_ids(ends: DataFrame) -> DataFrame:
    return ends.withColumn("id", edge_id(F.col("src"), F.col("dst"), F.col("type")))


def upsert(stored: DataFrame, new: DataFrame, fold) -> DataFrame:
    """stored, then new (which has seq), folded anew; stored rows come before all others."""
    low = stored.withColumn("seq", F.lit(-1).cast("long"))
    return fold(low.unionByName(new.withColumn("seq", F.col("seq").cast("long")), allowMissingColumns=True))


def delete(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id"), "id", "left_anti")


def page(rows: DataFrame, kind: str | None = None, order: tuple[str, ...] = ("name", "id"), limit: int | None = None, offset: int = 0) -> DataFrame:
    out = rows.where(F.col("kind") == kind) if kind else rows
    out = out.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def matches(query: str) -> Column:
    """Substring of name, path or id; A-Z fold, % and _ are wildcards, a backslash is itself."""
    pattern = "%" + query.lower().replace("\\", "\\\\") + "%"
    return F.coalesce(fold_ascii(F.col("name")).like(pattern), F.lit(False)) | F.coalesce(fold_ascii(F.col("path")).like(pattern), F.lit(False)) | fold_ascii(F.col("id")).like(pattern)


def search_like(nodes: DataFrame, query: str, limit: int | None = 50) -> DataFrame:
    return page(nodes.where(matches(query)), limit=limit)


def resolve(nodes: DataFrame, query: str) -> DataFrame:
    """At most one node: the exact id, else of the first ten search hits an exact name, an id ending in the query, the first."""
    exact = nodes.where(F.col("id") == query).withColumn("_rank", F.lit(0))
    suffix = F.col("id").endswith(f":{query}") | F.col("id").endswith(f"/{query}")
    hits = search_like(nodes, query, 10).withColumn("_rank", F.when(F.col("name") == query, 1).when(suffix, 2).otherwise(3))
    return exact.unionByName(hits).orderBy("_rank", "name", "id").limit(1).drop("_rank")


def neighbours(edges: DataFrame, id_: str, side: str = "both") -> DataFrame:
    """Edges out of, into or at a node; with both, a self-loop appears twice."""
    out, into = edges.where(F.col("src") == id_), edges.where(F.col("dst") == id_)
    if side == "out":
        return out
    return into if side == "in" else out.unionByName(into)


def where_used(nodes: DataFrame, edges: DataFrame, id_: str) -> DataFrame:
    e = neighbours(edges, id_, "in")
    return e.join(nodes.select(F.col("id").alias("src"), "kind", "name"), "src", "left").select("src", "type", "kind", "name")


def depends_on(nodes: DataFrame, edges: DataFrame, id_: str) -> DataFrame:
    e = neighbours(edges, id_, "out")
    return e.join(nodes.select(F.col("id").alias("dst"), "kind", "name"), "dst", "left").select("dst", "type", "kind", "name")


def ends(edges: DataFrame) -> DataFrame:
    """(id): distinct ends of edges."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def dangling(nodes: DataFrame, edges: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """Edges of which an end has no node, once each. met: ends(edges), where they are known.

    The distinct ends meet the nodes, and the edges only the ends that have none, which are written: of these there are few."""
    unknown = settle((ends(edges) if met is None else met).join(nodes.select("id").hint("merge"), "id", "left_anti"))
    n = unknown.count()
    bad_src, bad_dst = (sided(unknown.select(F.col("id").alias(end), F.lit(True).alias(name)), n) for end, name in (("src", "_s"), ("dst", "_d")))
    return edges.join(bad_src, "src", "left").join(bad_dst, "dst", "left").where("src is null or dst is null or _s or _d").drop("_s", "_d")


def validate(nodes: DataFrame, edges: DataFrame, bad: DataFrame | None = None) -> DataFrame:
    """(problem, id): dangling edges (bad, where they are known), self-loops and ids without a colon."""
    return (
        (dangling(nodes, edges) if bad is None else bad).select(F.lit("dangling").alias("problem"), "id")
        .unionByName(edges.where("src = dst").select(F.lit("self_loop").alias("problem"), "id"))
        .unionByName(nodes.where(~F.col("id").contains(":")).select(F.lit("bad_id").alias("problem"), "id"))
    )


def close_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds nodes for unknown ext: ends, and drops edges with other unknown ends."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).where(F.col("id").startswith("ext:")).distinct()
    new = ends.join(nodes.select("id"), "id", "left_anti").select("id", F.lit("External").alias("kind"), F.substring("id", 5, 1 << 30).alias("name"))
    nodes = nodes.unionByName(new, allowMissingColumns=True)
    ids = nodes.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes, kept
