"""Co-change, coverage, owners, search, diffs and resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.ids import dirname, tokens


# Fixed value: paths that look like contracts.
CONTRACT_PATH = r"(?i)(?:openapi|swagger|asyncapi|\.proto$|\.prisma$|\.sql$|/migrations/)"


def co_change(commits: DataFrame, min_count: int = 3, least: int = 2, most: int = 15) -> DataFrame:
    """(a, b, n, confidence): files changed together in min_count commits; commits of least..most files count."""
    f = commits.select("commit", "file").distinct()
    size = f.groupBy("commit").agg(F.count("*").alias("_n")).where(F.col("_n").between(least, most)).select("commit")
    f = f.join(size, "commit", "left_semi")
    pairs = f.select("commit", F.col("file").alias("a")).join(f.select("commit", F.col("file").alias("b")), "commit").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= min_count).withColumn("confidence", F.least(F.lit(1.0), F.col("n") / 10))


def churn(commits: DataFrame) -> DataFrame:
    return commits.groupBy("file").agg(F.count("*").alias("n"))


def coverage(spans: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, covered, total, pct): distinct hit lines inside each span (id, file, start_line, end_line) of a file.

    A span and a hit meet on the file and the block of lines: an equi-join for the range join."""
    block = 256
    s = spans.select("id", "file", "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / block), F.floor(F.col("end_line") / block))).alias("_k"))
    h = hits.where("hits > 0").select("file", "line", F.floor(F.col("line") / block).alias("_k")).distinct()
    n = s.join(h, ["file", "_k"]).where("line between start_line and end_line").groupBy("id").agg(F.countDistinct("line").alias("covered"))
    out = spans.join(n, "id", "left").select("id", F.coalesce("covered", F.lit(0)).cast("long").alias("covered"), (F.col("end_line") - F.col("start_line") + 1).cast("long").alias("total"))
    return out.withColumn("pct", F.floor(100 * F.col("covered") / F.col("total") + 0.5).cast("long"))


def tests_of(covered: DataFrame, functions: DataFrame, tests: DataFrame) -> DataFrame:
    """(test_id, fn_id, confidence): tests whose name or path tells of a covered function."""
    bare = F.regexp_replace(F.lower("test_name"), "^(test|spec)_?", "")
    fn = functions.join(covered.where("covered > 0"), "id").select(F.col("id").alias("fn_id"), F.lower("name").alias("fn"), (F.col("covered") / F.col("total")).alias("share"))
    t = tests.select(F.col("id").alias("test_id"), F.col("name").alias("test_name"), F.lower("path").alias("test_path")).withColumn("bare", bare)
    near = F.contains(F.lower("test_name"), F.col("fn")) | F.contains("fn", "bare") | F.coalesce(F.contains("test_path", "fn"), F.lit(False))
    return t.join(fn, near).select("test_id", "fn_id", F.least(F.lit(1.0), F.col("share") + 0.3).alias("confidence"))


def glob_matches(pattern: Column, path: Column) -> Column:
    """Owner patterns: the path itself, a directory, wildcards (** crosses slashes, * does not), or a prefix."""
    p = F.regexp_replace(pattern, "/$", "")
    rx = F.replace(F.replace(F.replace(F.replace(p, F.lit("."), F.lit(r"\.")), F.lit("**"), F.lit("\x01")), F.lit("*"), F.lit("[^/]*")), F.lit("\x01"), F.lit(".*"))
    return F.when(p == path, True).when(F.endswith(pattern, F.lit("/")), F.startswith(path, p)).when(F.contains(p, F.lit("*")), F.rlike(path, F.concat(F.lit("^"), rx, F.lit("$")))).otherwise(F.startswith(path, p))


def code_owners(rules: DataFrame, files: DataFrame, most_rules: int = 10_000) -> DataFrame:
    """(path, owners) from rules (line, pattern, owners): all matching rules' owners, in the order of their lines.

    Rules come from one file and are checked to be few; they go to the files, by broadcast."""
    if rules.limit(most_rules + 1).count() > most_rules:
        raise ValueError(f"more than {most_rules} owner rules")
    j = files.select("path").join(F.broadcast(rules), glob_matches(F.col("pattern"), F.col("path")))
    one = F.sort_array(F.collect_list(F.struct("line", "owners")))
    return j.groupBy("path").agg(F.array_distinct(F.flatten(F.transform(one, lambda x: x["owners"]))).alias("owners"))


def index(chunks: DataFrame) -> DataFrame:
    """(token, chunk_id): distinct tokens of chunks (chunk_id, content)."""
    return chunks.select("chunk_id", F.explode(F.array_distinct(tokens(F.col("content")))).alias("token"))


def search(chunks: DataFrame, query: str, limit: int | None = 10) -> DataFrame:
    """(chunk_id, score, snippet): share of the query's tokens (repeats count) that a chunk holds."""
    q = chunks.sparkSession.createDataFrame([(query,)], "q string").select(F.posexplode(tokens(F.col("q"))).alias("pos", "token"))
    n = q.count()
    hits = index(chunks).join(F.broadcast(q), "token").groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    out = hits.withColumn("score", F.col("n") / F.lit(max(1, n))).orderBy(F.desc("score"), "pos", "chunk_id")
    out = out.limit(limit) if limit is not None else out
    return out.join(chunks, "chunk_id").select("chunk_id", "score", F.substring("content", 1, 200).alias("snippet"))


def node_chunks(nodes: DataFrame) -> DataFrame:
    parts = [c for c in ("name", "kind", "path", "signature", "id") if c in nodes.columns]
    tags = [F.array_join("tags", " ")] if "tags" in nodes.columns else []
    return nodes.select(F.col("id").alias("chunk_id"), F.concat_ws(" ", *parts, *tags).alias("content"))


def score_docs(docs: DataFrame, target: str, target_path: str | None = None, limit: int | None = 12) -> DataFrame:
    """(id, score): parts of the target's words found in a document's name, path and id; its directory, READMEs and ADRs add."""
    parts = F.filter(F.split(F.lower(F.lit(target)), "[^a-z0-9]+"), lambda p: F.length(p) > 2)
    hay = F.lower(F.concat_ws(" ", "name", F.coalesce("path", F.lit("")), "id"))
    s = F.size(F.filter(parts, lambda p: F.contains(hay, p)))
    low = F.lower(F.coalesce("path", F.lit("")))
    if target_path:
        s = s + F.when(dirname(F.col("path")) == dirname(F.lit(target_path)), 2).otherwise(0)
    s = s + F.when(low.contains("readme"), 1).otherwise(0) + F.when(low.contains("adr"), 1).otherwise(0)
    out = docs.withColumn("score", s).where("score > 0").orderBy(F.desc("score"), "name", "id")
    return (out.limit(limit) if limit is not None else out).select("id", "score")


def symbol_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change, old_signature, new_signature) of symbols (id, signature, body): signatures are compared trimmed."""
    a = old.select("id", F.trim("signature").alias("os"), F.col("body").alias("ob"), F.lit(1).alias("_a"))
    b = new.select("id", F.trim("signature").alias("ns"), F.col("body").alias("nb"), F.lit(1).alias("_b"))
    j = a.join(b, "id", "full")
    change = F.when(F.col("_b").isNull(), "removed").when(F.col("_a").isNull(), "added").when(~F.col("os").eqNullSafe(F.col("ns")), "signature_changed").when(~F.col("ob").eqNullSafe(F.col("nb")), "body_only")
    return j.select("id", change.alias("change"), F.col("os").alias("old_signature"), F.col("ns").alias("new_signature")).where("change is not null")


def bodies(symbols: DataFrame, content: Column) -> DataFrame:
    """Adds signature (the line at start_line) and body (the lines after it, up to end_line)."""
    lines = F.split(content, "\r?\n")
    sig = F.coalesce(F.get(lines, F.col("start_line") - 1), F.col("signature"))
    n = F.coalesce(F.col("end_line") - F.col("start_line"), F.lit(0))
    return symbols.withColumn("body", F.when(n > 0, F.array_join(F.slice(lines, F.col("start_line") + 1, n), "\n")).otherwise("")).withColumn("signature", sig)


def manifest(files: DataFrame) -> DataFrame:
    """(path, hash, size) of files (path, content)."""
    return files.select("path", F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("long").alias("size"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, changed or removed."""
    j = old.select("path", F.col("hash").alias("a")).join(new.select("path", F.col("hash").alias("b")), "path", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return j.select("path", change.alias("change")).where("change is not null")


def reparse_closure(changed: DataFrame, files: DataFrame) -> DataFrame:
    """(path): changed files and those whose content names one of them without its ending."""
    names = changed.select(F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "").alias("base")).where("base <> ''").distinct()
    near = files.join(names, F.contains("content", "base"), "left_semi")
    return changed.select("path").union(near.select("path")).distinct()


def contract_deltas(contracts: DataFrame, changed: DataFrame) -> DataFrame:
    """(contract_id): contracts whose path is, holds or lies in a changed path, and changed files that look like one."""
    c = contracts.where("path is not null").select("id", F.col("path").alias("cp"))
    hit = c.join(changed.select("path"), F.contains("path", "cp") | F.contains("cp", "path"), "left_semi").select(F.col("id").alias("contract_id"))
    alike = changed.where(F.rlike("path", F.lit(CONTRACT_PATH))).select(F.concat(F.lit("contract:"), "path").alias("contract_id"))
    return hit.union(alike).distinct()


def unique_symbols(definitions: DataFrame) -> DataFrame:
    """(symbol, id) of symbols (symbol, path, id) that one file alone defines."""
    return definitions.groupBy("symbol").agg(F.countDistinct("path").alias("_n"), F.max("id").alias("id")).where("_n = 1").drop("_n")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (path, target) with the first file (by seq) equal to the target without ending, or its index file."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"\.(tsx?|jsx?|mjs|cjs)$", ""), "/index$", "")
    f = files.groupBy(bare(F.col("path")).alias("_k")).agg(F.min_by("path", "seq").alias("file"))
    return imports.withColumn("_k", bare(F.col("target"))).join(f, "_k", "left").drop("_k")


def resolve_calls(calls: DataFrame, definitions: DataFrame, imports: DataFrame) -> DataFrame:
    """calls (caller, path, name) with the callee and confidence: local 1.0, imported 0.95, unique in all files 0.75."""
    local = definitions.groupBy("path", F.col("symbol").alias("name")).agg(F.max("id").alias("_l"))
    imported = imports.join(definitions.select(F.col("path").alias("file"), F.col("symbol").alias("name"), F.col("id").alias("_i")), "file").groupBy("path", "name").agg(F.max("_i").alias("_i"))
    every = unique_symbols(definitions).select(F.col("symbol").alias("name"), F.col("id").alias("_g"))
    j = calls.join(local, ["path", "name"], "left").join(imported, ["path", "name"], "left").join(every, "name", "left")
    conf = F.when(F.col("_l").isNotNull(), 1.0).when(F.col("_i").isNotNull(), 0.95).when(F.col("_g").isNotNull(), 0.75)
    return j.select("caller", "name", F.coalesce("_l", "_i", "_g").alias("callee"), conf.alias("confidence")).where("callee is not null")


def journal_tail(journal: DataFrame, n: int = 50, event: str | None = None) -> DataFrame:
    """The last n entries by seq, oldest first; an event is looked for within the last 1000."""
    last = journal.orderBy(F.desc("seq")).limit(n if event is None else 1000)
    if event is not None:
        last = last.where(F.col("event") == event).orderBy(F.desc("seq")).limit(n)
    return last.orderBy("seq")


def conflict_streaks(proposals: DataFrame) -> DataFrame:
    """(repo, seq, streak): how many conflicts in a row end at each proposal (gaps and islands)."""
    w = Window.partitionBy("repo").orderBy("seq")
    d = proposals.withColumn("_g", F.sum(F.when(F.col("is_conflict"), 0).otherwise(1)).over(w))
    run = F.sum(F.col("is_conflict").cast("int")).over(Window.partitionBy("repo", "_g").orderBy("seq"))
    return d.select("repo", "seq", run.cast("long").alias("streak"))
