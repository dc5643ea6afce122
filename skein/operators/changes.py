"""What a change of files does (D2, J18, J19), checks of an agent's work (V5), budgets (A19), pickers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.analytics import verify
from skein.operators.loops import settle
from skein.operators.mining import contract_deltas, symbol_diff
from skein.operators.store import page, resolve, search_like
from skein.operators.traverse import flow, impact

# Where reports of coverage lie, their names elsewhere, branches that a change is held against.
COVERAGE_PATHS = ("coverage/lcov.info", "coverage/coverage-final.json", ".coverage/lcov.info", "test/coverage/lcov.info", "tmp/coverage/lcov.info")
COVERAGE_NAMES = ("lcov.info", "coverage-final.json")
BASES = ("main", "master", "origin/main", "HEAD")
# Kinds that a change of files is told by.
CHANGEABLE = ("Function", "Method", "Class", "Interface", "API", "Route", "Table", "Test", "Event", "Job")


def known_symbols(changed: DataFrame, nodes: DataFrame) -> DataFrame:
    """The changed symbols (id, ...) that the graph has."""
    return changed.join(nodes.select("id"), "id", "left_semi")


def symbols_on(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The graph's symbols on changed paths (path): what counts as changed where no symbol was found to differ."""
    return nodes.where(F.col("kind").isin(*CHANGEABLE)).join(paths.select("path"), "path", "left_semi")


def diff_impact(nodes: DataFrame, edges: DataFrame, old: DataFrame, new: DataFrame, changed: DataFrame, max_depth: int = 5) -> dict[str, DataFrame]:
    """symbols (id, change, ...), impact (source 'diff', id, ..., depth) of all of them together, contracts (contract_id).

    old and new: symbols (id, signature, body) of both sides of the changed files; changed: (path)."""
    symbols = settle(symbol_diff(old, new))
    if symbols.isEmpty():
        sig = F.lit(None).cast("string")
        symbols = symbols_on(nodes, changed).select("id", F.lit("body_only").alias("change"), sig.alias("old_signature"), sig.alias("new_signature"))
    starts = known_symbols(symbols, nodes).select(F.lit("diff").alias("source"), "id")
    contracts = contract_deltas(nodes.where("kind = 'Contract'").select("id", "path"), changed)
    return {"symbols": symbols, "impact": impact(nodes, edges, starts, "downstream", max_depth), "contracts": contracts}


def verify_work(nodes: DataFrame, edges: DataFrame, claims: DataFrame | None = None, allowed: DataFrame | None = None, touched: DataFrame | None = None) -> DataFrame:
    """(name, passed, message): checks of the graph, of touched files against the plan's, of claimed ids, of conflicts.

    Touched files without a plan are refused. A claim (claim) holds if a node has it as id or name, or an id that ends in it."""
    out = verify(nodes, edges, allowed, touched)
    if touched is not None and allowed is None:
        some = touched.agg((F.count("*") == 0).alias("passed"))
        out = out.unionByName(some.where("not passed").select(F.lit("envelope_required").alias("name"), "passed", F.lit("files without a plan").alias("message")))
    if claims is not None:
        asked = claims.select("claim").distinct()
        names = nodes.select(F.explode(F.array("id", "name", F.substring_index("id", ":", -1), F.substring_index("id", "/", -1))).alias("claim"))
        c = asked.join(names.join(asked, "claim", "left_semi").distinct().withColumn("_ok", F.lit(True)), "claim", "left")  # of the names only those claimed
        ok = F.col("_ok").isNotNull()
        out = out.unionByName(c.select(F.concat(F.lit("claim_"), "claim").alias("name"), ok.alias("passed"), F.when(ok, "in the graph").otherwise("not in the graph").alias("message")))
    if "conflict" in edges.columns:
        n = edges.agg(F.count(F.when(F.col("conflict"), 1)).alias("n"))
        out = out.unionByName(n.select(F.lit("no_unexplained_conflicts").alias("name"), (F.col("n") == 0).alias("passed"), F.concat(F.col("n").cast("string"), F.lit(" conflict edges")).alias("message")))
    return out


def budgets(calls: DataFrame, max_calls: int = 20, max_input: int = 100_000, max_output: int = 30_000, max_seconds: float = 300.0) -> DataFrame:
    """calls (run, seq, input, output, seconds since the run's start) with running sums, and whether the next call is blocked."""
    w = Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    d = calls.select("run", "seq", F.count("*").over(w).alias("calls"), F.sum("input").over(w).alias("input"), F.sum("output").over(w).alias("output"), "seconds")
    spent = (F.col("calls") >= max_calls) | (F.col("input") >= max_input) | (F.col("output") >= max_output) | (F.col("seconds") > max_seconds)
    return d.select("run", "seq", "calls", "input", "output", F.coalesce(spent, F.lit(False)).alias("blocked"))


def find(nodes: DataFrame, query: str) -> DataFrame:
    """At most one node: the exact id, else the first search hit by name and id."""
    exact = nodes.where(F.col("id") == query).withColumn("_rank", F.lit(0))
    return exact.unionByName(search_like(nodes, query, 1).withColumn("_rank", F.lit(1))).orderBy("_rank").limit(1).drop("_rank")


def list_search(nodes: DataFrame, query: str = "", kind: str | None = None, limit: int | None = 150) -> DataFrame:
    """Nodes of a kind whose name, id or path holds the query, whatever its case, by name and id."""
    low = query.lower()
    holds = lambda c: F.coalesce(F.contains(F.lower(F.col(c)), F.lit(low)), F.lit(False))
    return page(nodes.where(holds("name") | holds("id") | holds("path")), kind, limit=limit)


def quick_pick(nodes: DataFrame, answer: str | None = None, shown: int = 20, pool: int | None = 500) -> DataFrame:
    """The first nodes to pick from, files left out unless there are but files; with an answer, the one that its number
    or a part of a name or id picks."""
    first = settle(page(nodes, limit=pool))
    plain = first.where("kind <> 'File'")
    display = first if plain.isEmpty() else plain
    ranked = display.withColumn("place", F.row_number().over(Window.orderBy("name", "id"))) if pool is not None else display.withColumn("place", F.lit(None).cast("int"))
    if answer is None:
        return page(display, limit=shown)
    text = answer.strip()
    if pool is not None and text.isascii() and text.isdigit() and 1 <= int(text) <= shown:
        hit = ranked.where(F.col("place") == int(text)).drop("place")
        if not hit.isEmpty():
            return hit
    part = F.contains(F.lower("name"), F.lit(text.lower())) | F.contains(F.lower("id"), F.lit(text.lower()))
    return page(display.where(part), limit=1)


def degree_once(edges: DataFrame) -> DataFrame:
    """(id, degree): edges at each node, a loop counted once."""
    ends = edges.select(F.col("src").alias("id")).union(edges.where("src <> dst").select("dst"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def flow_from_api(nodes: DataFrame, edges: DataFrame, method: str, path: str) -> DataFrame:
    return flow(nodes, edges, f"api:{method.upper()}:{path}")


def flow_from(nodes: DataFrame, edges: DataFrame, query: str) -> DataFrame:
    """The flow from the node that a query names; no rows if none does."""
    hit = resolve(nodes, query).first()
    return flow(nodes, edges, hit["id"] if hit else "")


def coverage_files(files: DataFrame) -> DataFrame:
    """(path, place) of the reports of coverage among files (path): the usual places first, then any but those of packages."""
    usual = F.array_position(F.array(*map(F.lit, COVERAGE_PATHS)), F.col("path"))
    named = F.endswith("path", F.lit(COVERAGE_NAMES[0])) | F.endswith("path", F.lit(COVERAGE_NAMES[1]))
    place = F.when(usual > 0, usual).when(named & ~F.contains("path", F.lit("node_modules")), len(COVERAGE_PATHS) + 1)
    return files.select("path", place.cast("int").alias("place")).where("place is not null").distinct()


def base_ref(refs: DataFrame) -> DataFrame:
    """One row (ref): the first of the usual branches among refs (ref); HEAD where there is none."""
    place = F.array_position(F.array(*map(F.lit, BASES)), F.col("ref"))
    return refs.where(place > 0).agg(F.coalesce(F.min_by("ref", place), F.lit(BASES[-1])).alias("ref"))


def chain_of(lines: DataFrame, name: str, max_depth: int = 5, max_rows: int | None = 30) -> DataFrame:
    """(depth, callee, caller, path, line_no): who mentions a call of `name` in lines (path, line_no, text, caller), then
    who calls those, and so on; a caller is followed once. caller: the function that a line lies in, or null."""
    calls = lines.select("path", "line_no", "caller", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Za-z_]\w*)\s*\("), 1))).alias("callee"))
    calls = settle(calls.where(~F.col("callee").eqNullSafe(F.col("caller"))))
    front = seen = settle(lines.sparkSession.createDataFrame([(name,)], "callee string"))
    found = None
    for depth in range(1, max_depth + 1):
        hit = settle(calls.join(front, "callee").select(F.lit(depth).alias("depth"), "callee", "caller", "path", "line_no"))
        found = hit if found is None else found.unionByName(hit)
        front = settle(hit.where("caller is not null").select(F.col("caller").alias("callee")).distinct().join(seen, "callee", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.union(front)
    out = found.orderBy("depth", "path", "line_no", "callee")
    return out.limit(max_rows) if max_rows is not None else out
