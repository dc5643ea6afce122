"""Scans of sources: layers of an import graph, exports that nobody uses, modules that do too much, imports across layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.cyclic import strong_components
from skein.operators.loops import drop_settled, settle

# What an export and a use look like, weights and bounds of a module's score, folders and names of layers.
EXPORT = r"export\s+(?:function|const|class|interface|type|enum)\s+(\w+)"
MADE = r"function|const\s+\w+\s*=\s*(async\s+)?\("
WEIGHTS = {"exports": 1, "functions": 2, "classes": 3}
SCORE, LENGTH = 15, 400
ACROSS = (
    ("ui to database", r"^(components|pages|app)/", r"import.*from.*(db|store|prisma|knex|sequelize|mongoose)"),
    ("client to server", r"^(components|pages)/", r"import.*from.*(server|api|middleware)"),
)


def layers(edges: DataFrame) -> DataFrame:
    """(id, layer, component): the length of the longest way from a node down to one that depends on nothing, counted over components.

    edges: (src, dst), src depends on dst. Nodes on a common cycle are one component (its smallest id) with one layer; self-loops count for
    nothing. Each round drops the edges to nodes that wait for nothing; a node's layer is the last round in which it waits. Rounds are as
    many as layers, each is written."""
    e = settle(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    comp = settle(strong_components(e).select("id", "component"))
    ids = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct()
    member = settle(ids.join(comp, "id", "left").select("id", F.coalesce("component", "id").alias("component")))
    of = lambda c: member.select(F.col("id").alias(c), F.col("component").alias(f"_{c}"))
    rest = settle(e.join(of("src"), "src").join(of("dst"), "dst").where("_src <> _dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct())
    drop_settled(e, comp)
    told, n = [], 0
    while True:
        waiting = settle(rest.select(F.col("src").alias("id")).distinct())
        if waiting.isEmpty():
            break
        n += 1
        told.append(waiting.select("id", F.lit(n).alias("layer")))
        left = settle(rest.join(waiting.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))
        drop_settled(rest)
        rest = left
    deep = member.select(F.col("component").alias("id")).distinct().withColumn("layer", F.lit(0))
    for t in told:
        deep = deep.unionByName(t)
    deep = deep.groupBy("id").agg(F.max("layer").alias("layer"))
    return member.join(deep.withColumnRenamed("id", "component"), "component").select("id", "layer", "component")


def exports(lines: DataFrame) -> DataFrame:
    """(path, name) of what lines (path, line_no, text) export; names of three characters or more."""
    d = lines.select("path", F.explode(F.regexp_extract_all("text", F.lit(EXPORT), 1)).alias("name"))
    return d.where(F.length("name") >= 3).distinct()


def dead_exports(lines: DataFrame, few: int = 2) -> DataFrame:
    """(path, name, uses): exports that stand, as whole words, in fewer than `few` lines of other files.

    Only words that are exported meet the exports; lines are counted by word and file before they are shuffled on."""
    made = settle(exports(lines))
    word = lines.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\w+)"), 1))).alias("name"))
    by_file = settle(word.join(made.select("name").distinct(), "name", "left_semi").groupBy("name", "path").agg(F.count("*").alias("n")))
    total = by_file.groupBy("name").agg(F.sum("n").alias("all"))
    j = made.join(total, "name", "left").join(by_file, ["name", "path"], "left")
    uses = F.coalesce("all", F.lit(0)) - F.coalesce("n", F.lit(0))
    return j.select("path", "name", uses.alias("uses")).where(F.col("uses") < few)


def god_modules(files: DataFrame) -> DataFrame:
    """(path, lines, exports, functions, classes, score) of the files (path, content) whose score or length is above the bounds."""
    n = lambda rx: F.regexp_count("content", F.lit(rx)).cast("long")
    d = files.where("content is not null").select("path", F.size(F.split("content", "\n", -1)).cast("long").alias("lines"), n("export ").alias("exports"), n(MADE).alias("functions"), n("class ").alias("classes"))
    score = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0))
    return d.withColumn("score", score.cast("long")).where((F.col("score") >= SCORE) | (F.col("lines") > LENGTH))


def across_layers(lines: DataFrame) -> DataFrame:
    """(rule, path, line_no, text) of imports from a layer that its folder should not know."""
    rules = F.array(*(F.when(F.rlike("path", F.lit(folder)) & F.rlike("text", F.lit(what)), F.lit(name)) for name, folder, what in ACROSS))
    return lines.select(F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"), "path", "line_no", F.trim("text").alias("text"))
