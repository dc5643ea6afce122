"""Small operators composed of others: sentences, paths, events, workspaces, file statistics, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.ids import edge_id
from skein.operators.analytics import cycles
from skein.schema import AFFECTED_ORDER

# How an edge type reads in a path.
VERBS = {
    "CALLS": "calls", "IMPORTS": "imports", "EXPOSES": "exposes", "CONSUMES": "consumes", "READS": "reads", "WRITES": "writes", "PUBLISHES": "publishes",
    "SUBSCRIBES": "subscribes to", "TESTS": "tests", "DEPENDS_ON": "depends on", "CONTAINS": "contains", "DOCUMENTS": "documents", "IMPLEMENTS": "implements",
}
# Names of documents inside a repository.
DOC_NAMES = r"(?i)(^|/)(readme|contributing|architecture|changelog|llms\.txt|agents|claude|adr)[^/]*$|(^|/)docs?/"
SECRET = r"(?i)(api[_-]?key|secret|password|passwd|token|private[_-]?key)\s*[:=]\s*\S{6,}"


def affected(reported: DataFrame) -> DataFrame:
    """(kind, rank, ids): nodes met by kind in a fixed order, starts left out; a kind stays even if only starts have it."""
    rank = F.array_position(F.array(*map(F.lit, AFFECTED_ORDER)), F.col("kind"))
    d = reported.groupBy("kind").agg(F.sort_array(F.collect_list(F.when(F.col("depth") > 0, F.col("id")))).alias("ids"))
    return d.withColumn("rank", rank).where("rank > 0").select("kind", "rank", "ids")


def impact_summary(reported: DataFrame) -> DataFrame:
    """(source, text): how many nodes of each kind a change reaches."""
    n = reported.where("depth > 0").groupBy("source", "kind").agg(F.count("*").alias("n"))
    one = F.concat(F.col("n").cast("string"), F.lit(" "), F.col("kind"))
    parts = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("kind"), one.alias("t"))))
    return n.groupBy("source").agg(F.concat(F.lit("Reaches "), F.array_join(F.transform(parts, lambda x: x["t"]), ", ")).alias("text"))


def describe_path(path: Column, edges: DataFrame) -> Column:
    """A path of edges (array of struct src, type, dst) as a sentence."""
    verbs = F.create_map(*(F.lit(x) for kv in VERBS.items() for x in kv))
    return F.array_join(F.transform(path, lambda s: F.concat_ws(" ", s["src"], F.coalesce(F.try_element_at(verbs, s["type"]), F.lower(s["type"])), s["dst"])), " -> ")


def record_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """BROKE_BEFORE edges and journal rows of events (seq, src, dst, note, source)."""
    e = events.select(edge_id(F.col("src"), F.col("dst"), F.lit("BROKE_BEFORE")).alias("id"), F.lit("BROKE_BEFORE").alias("type"), "src", "dst", F.array(F.struct(F.col("src").alias("file"), F.lit(1).alias("line"), F.col("note").alias("snippet"))).alias("evidence"), F.array("source").alias("sources"), F.lit(1.0).alias("confidence"), F.lit(False).alias("conflict"), "seq")
    return e, events.select("seq", F.lit("record_event").alias("event"), F.create_map(F.lit("from"), "src", F.lit("to"), "dst").alias("details"))


def pins(ends: DataFrame, by: str = "user") -> DataFrame:
    """Edges that a user or an agent states, for fold_edges."""
    note = F.array(F.struct(F.lit(by).alias("file"), F.lit(1).alias("line"), F.lit("pinned").alias("snippet")))
    return ends.select(edge_id(F.col("src"), F.col("dst"), F.col("type")).alias("id"), "type", "src", "dst", note.alias("evidence"), F.array(F.lit(by)).alias("sources"), F.lit(1.0).alias("confidence"), F.lit(False).alias("conflict"))


def workspace_edges(packages: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(src, dst): repositories that depend on others, by package name or its part after the scope.

    packages (repo, package); dependencies (repo, dependency)."""
    short = packages.select("repo", F.col("package").alias("key")).union(packages.select("repo", F.regexp_replace("package", "^@[^/]+/", ""))).distinct()
    d = dependencies.select(F.col("repo").alias("src"), F.col("dependency").alias("key")).join(short.select(F.col("repo").alias("dst"), "key"), "key")
    return d.where("src <> dst").select(F.concat(F.lit("repo:"), "src").alias("src"), F.concat(F.lit("repo:"), "dst").alias("dst")).distinct()


def repo_docs(files: DataFrame) -> DataFrame:
    return files.where(F.rlike("path", F.lit(DOC_NAMES))).select(F.concat(F.lit("doc:"), "path").alias("id"), F.lit("Doc").alias("kind"), F.substring_index("path", "/", -1).alias("name"), "path")


def file_statistics(lines: DataFrame) -> DataFrame:
    """(path, code, comment, blank, branches, exports) of lines (path, line_no, text)."""
    blank = F.trim("text") == ""
    comment = F.rlike("text", F.lit(r"^\s*(//|#|\*|/\*)"))
    branch = F.regexp_count("text", F.lit(r"\b(if|for|while|case|catch|elif|except)\b|&&|\|\||\?"))
    n = lambda c: F.count(F.when(c, 1))
    return lines.groupBy("path").agg(n(~blank & ~comment).alias("code"), n(comment & ~blank).alias("comment"), n(blank).alias("blank"), F.coalesce(F.sum(F.when(~comment, branch)), F.lit(0)).cast("long").alias("branches"), n(F.rlike("text", F.lit(r"^\s*export\b"))).alias("exports"))


def import_cycles(imports: DataFrame, max_length: int | None = None, limit: int = 11) -> DataFrame:
    """Cycles among files (path, file)."""
    e = imports.where("file is not null").select(F.lit("IMPORTS").alias("type"), F.col("path").alias("src"), F.col("file").alias("dst"))
    return cycles(e, max_length, limit)


def grep(lines: DataFrame, pattern: str, limit: int | None = None) -> DataFrame:
    out = lines.where(F.rlike("text", F.lit(pattern))).select("path", "line_no", F.trim("text").alias("text"))
    return out.orderBy("path", "line_no").limit(limit) if limit is not None else out


def secrets(lines: DataFrame) -> DataFrame:
    return grep(lines, SECRET)


# Fixed value: a verb of change and what it is about.
CHANGE_OF = r"(?i)(?:change|impact|modify|edit|touch|break)\s+(?:of\s+)?([A-Za-z_][A-Za-z0-9_.]*)"


def target_of(request: Column) -> Column:
    """What a free request is about: its quoted part, else what follows a verb of change, else the last word longer than
    three characters."""
    after = F.regexp_extract(request, CHANGE_OF, 1)
    quoted = F.regexp_extract(request, r"[\"'`]([^\"'`]+)[\"'`]", 1)
    words = F.filter(F.split(F.regexp_replace(request, r"[^\w./:-]+", " "), " "), lambda w: F.length(w) > 3)
    return F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(after, F.lit("")), F.try_element_at(words, F.lit(-1)))


def tier(request: Column) -> Column:
    """Which tier a request needs: none for look-ups, strong for changes of design, else fast."""
    low = F.lower(request)
    return F.when(F.rlike(low, F.lit(r"\b(list|show|count|where|who|find|search|status|health)\b")), "none").when(F.rlike(low, F.lit(r"\b(refactor|redesign|architect|migrate|rewrite|security|plan)\b")), "strong").otherwise("fast")


def tail_conflicts(edges: DataFrame, sample: int | None = None) -> DataFrame:
    """(conflicts, without_evidence) over edges, or a sample of the first by update and id."""
    e = edges.orderBy("updated_at", "id").limit(sample) if sample else edges
    return e.agg(F.count(F.when(F.col("conflict"), 1)).alias("conflicts"), F.count(F.when(F.size("evidence") <= 0, 1)).alias("without_evidence"))
