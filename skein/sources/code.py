"""Definitions, imports, calls, routes, tables and events of source files, by line patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.ids import edge_id
from skein.operators import intervals
from skein.operators.loops import settle
from skein.operators.mining import bodies, resolve_imports
from skein.operators.store import close_graph
from skein.sources import binding
from skein.sources.files import evidence, is_test, language
from skein.sources.spans import brace_ends, closings, file_lines, hidden, indent_ends, masked_files, nested_ends, once

# Fixed values: (languages, kind, pattern with the name as its first group, confidence); the first that matches a line counts.
DEFINITIONS = (
    ("typescript javascript", "Function", r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(", 1.0),
    ("typescript javascript", "Function", r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|\w+)\s*=>", 1.0),
    ("typescript javascript", "Method", r"static\s+(?:async\s+)?(\w+)\s*\(([^)]*)\)", 1.0),
    ("typescript javascript", "Method", r"^\s+(?:async\s+)?(\w+)\s*\(([^)]*)\)\s*(?::\s*\S+)?\s*\{", 1.0),
    ("typescript javascript", "Class", r"(?:export\s+)?(?:abstract\s+)?class\s+(\w+)", 1.0),
    ("typescript javascript", "Interface", r"(?:export\s+)?interface\s+(\w+)", 1.0),
    ("python", "Method", r"^\s+(?:async\s+)?def\s+(\w+)\s*\(", 1.0),
    ("python", "Function", r"^(?:async\s+)?def\s+(\w+)\s*\(", 1.0),
    ("python", "Class", r"^\s*class\s+(\w+)", 1.0),
    ("java", "Class", r"(?:public|private|protected)?\s*(?:abstract\s+)?(?:class|interface)\s+(\w+)", 1.0),
    ("java", "Method", r"(?:public|private|protected|static|final)\s+(?:\w+(?:<[^>]*>)?\s+)+(\w+)\s*\([^;]*\{", 1.0),
    ("go", "Function", r"^func\s+(?:\([^)]*\)\s+)?(\w+)\s*\(", 0.8),
    ("go", "Class", r"^type\s+(\w+)\s+(?:struct|interface)", 0.8),
    ("rust", "Function", r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)", 0.8),
    ("rust", "Class", r"^(?:pub\s+)?(?:enum|struct|trait)\s+(\w+)", 0.8),
    ("ruby", "Function", r"^\s*def\s+(?:self\.)?(\w+[?!]?)", 0.7),
    ("ruby php csharp swift kotlin scala cpp", "Class", r"^(?:public |private |internal |final |abstract |data |sealed |open |case )*(?:class|module|struct|trait|protocol|interface)\s+(\w+)", 0.7),
    ("php", "Function", r"^\s*(?:public |private |protected |static )*function\s+(\w+)", 0.7),
    ("swift", "Function", r"^\s*(?:public |private |internal |static |mutating )*func\s+(\w+)", 0.7),
    ("kotlin", "Function", r"^\s*(?:public |private |protected |internal |suspend )*fun\s+(\w+)", 0.7),
    ("scala", "Function", r"^\s*(?:override\s+)?def\s+(\w+)", 0.7),
    ("csharp", "Function", r"^\s*(?:public |private |protected |internal |static |async |virtual |override )+[\w<>\[\]]+\s+(\w+)\s*\(", 0.7),
    ("c cpp", "Function", r"^(?:static\s+|inline\s+|extern\s+)?\w+(?:\s*\*+|\s)\s*(\w+)\s*\([^;]*$", 0.6),
    ("shell", "Function", r"^(?:function\s+)?(\w+)\s*\(\)\s*\{", 0.6),
    ("sql", "Table", r"(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?['\"]?(\w+)", 1.0),
    ("prisma", "Table", r"^model\s+(\w+)\s*\{", 1.0),
)
# Fixed values: (languages, pattern with the target as its first group).
IMPORTS = (
    ("typescript javascript", r"(?:import|export)\s+(?:[^'\"]*?\s+from\s+)?['\"]([^'\"]+)['\"]"),
    ("typescript javascript", r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"),
    ("python", r"^from\s+(\S+)\s+import\s+"),
    ("python", r"^import\s+(\S+)"),
    ("java", r"^import\s+(?:static\s+)?([a-zA-Z0-9_.]+);"),
    ("go", r"^\s*(?:import\s+)?(?:\w+\s+)?\"([^\"]+)\"\s*$"),
    ("rust", r"^(?:pub\s+)?use\s+([a-zA-Z0-9_:]+)"),
    ("ruby", r"^\s*(?:require_relative|require|autoload)\s*['\"]([^'\"]+)['\"]"),
    ("php", r"^use\s+([A-Za-z0-9_\\]+);"),
    ("csharp", r"^using\s+([A-Za-z0-9_.]+);"),
    ("swift kotlin scala", r"^import\s+([a-zA-Z0-9_.]+)"),
    ("c cpp", r"^#\s*include\s*[<\"]([^>\"]+)[>\"]"),
)
# Names that are no calls.
NOT_CALLS = (
    "if", "for", "while", "switch", "catch", "return", "throw", "new", "delete", "typeof", "instanceof", "void", "in", "of", "class", "function",
    "const", "let", "var", "import", "export", "from", "require", "console", "Promise", "Error", "Math", "Date", "JSON", "Array", "Object", "Map",
    "Set", "RegExp", "Number", "String", "Boolean", "parseInt", "parseFloat", "isNaN", "undefined", "null", "true", "false", "this", "super",
    "async", "await", "yield", "def", "elif", "print", "len", "not", "and", "or", "with", "lambda",
)
# Routes, access to tables, events and tests in a line.
ROUTE = r"(?i)(?:app|router|route)\.(get|post|put|delete|patch|options)\s*\(\s*['\"]([^'\"]+)['\"]\s*,\s*(\w+)"
DECORATOR = r"(?i)@(?:app|router|blueprint)\.(get|post|put|patch|delete|route)\s*\(\s*['\"]([^'\"]+)['\"]"
WRITES = r"(?i)['\"`].*?\b(?:INSERT\s+INTO\s+['\"`]?(\w+)|UPDATE\s+['\"`]?(\w+)\s+SET|DELETE\s+FROM\s+['\"`]?(\w+))"
READS = r"(?i)['\"`].*?\bSELECT\b.+?\bFROM\s+['\"`]?(\w+)"
PRISMA = r"prisma\.(\w+)\.(create|update|delete|upsert|findMany|findUnique|findFirst)"
EVENT = r"\.(emit|publish|subscribe)\s*\(\s*['\"`]([^'\"`]+)['\"`]"
TEST = r"(?:\b(?:it|test|describe)\s*\(\s*['\"`]([^'\"`]+)['\"`])|(?:^\s*(?:async\s+)?def\s+(test_\w+)\s*\()|(?:void\s+(test\w+)\s*\()"
# Languages whose definitions end with a brace; the others end by indentation.
BRACED = ("typescript", "javascript", "java", "go", "rust", "php", "swift", "kotlin", "scala", "csharp", "c", "cpp", "shell", "prisma")
#: Parts of a line without which these patterns cannot match: looked for before the pattern is tried. Fixed values.
PARTS = {
    r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(": ("function",),
    r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|\w+)\s*=>": ("=>",),
    r"static\s+(?:async\s+)?(\w+)\s*\(([^)]*)\)": ("static",),
    r"^\s+(?:async\s+)?(\w+)\s*\(([^)]*)\)\s*(?::\s*\S+)?\s*\{": ("(", ")", "{"),
    r"(?:export\s+)?(?:abstract\s+)?class\s+(\w+)": ("class",),
    r"(?:export\s+)?interface\s+(\w+)": ("interface",),
}
PREFIX = {"Function": "fn", "Method": "fn", "Class": "cls", "Interface": "iface", "Table": "table"}


def source_lines(files: DataFrame) -> DataFrame:
    """(path, lang, line_no, text), embedded texts blanked."""
    return masked_files(files.select("path", language(F.col("path")).alias("lang"), "content")).select("path", "lang", "line_no", "text")


def _hit(text: Column, lang: Column | None = None, patterns=DEFINITIONS) -> Column:
    """(kind, symbol, confidence) of the first of the patterns, of a line's language if one is given, that matches it, or null."""
    out = F.lit(None).cast("struct<kind:string,symbol:string,confidence:double>")
    for langs, kind, rx, conf in reversed(patterns):
        name = F.regexp_extract(text, rx, 1)
        ok = lang.isin(*langs.split()) if lang is not None else F.lit(True)
        for part in PARTS.get(rx, ()):
            ok = ok & F.contains(text, F.lit(part))
        out = F.when(ok & (name != "") & ~name.isin(*NOT_CALLS), F.struct(F.lit(kind).alias("kind"), name.alias("symbol"), F.lit(conf).alias("confidence"))).otherwise(out)
    return out


def _id() -> Column:
    """The id of a definition (kind, path, symbol)."""
    prefix = F.create_map(*(F.lit(x) for kv in PREFIX.items() for x in kv))[F.col("kind")]
    return F.when(F.col("kind") == "Table", F.concat(F.lit("table:"), "symbol")).otherwise(F.concat(prefix, F.lit(":"), "path", F.lit(":"), "symbol"))


def definitions(src: DataFrame, raw: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """(id, kind, symbol, path, lang, start_line, end_line, signature, confidence) of functions, methods, classes and tables.

    raw: the lines (path, line_no, text) before embedded texts were blanked, in which braces are looked for; or the files
    (path, content) themselves."""
    # as a function of an array's element: the patterns together make a method too long for the JVM to compile
    found = F.filter(F.transform(F.array(F.struct("lang", "text")), lambda x: _hit(x["text"], x["lang"])), lambda x: x.isNotNull())
    d = settle(src.select("path", "lang", "line_no", "text", F.explode(found).alias("d")).select("path", "lang", "line_no", "text", "d.*"))
    braced = F.col("lang").isin(*BRACED)
    ends = brace_ends(src if raw is None else raw, d.where(braced), files).unionByName(indent_ends(src.where(~braced), d.where(~braced)))
    d = d.join(settle(ends), ["path", "line_no"])
    return d.select(_id().alias("id"), "kind", "symbol", "path", "lang", F.col("line_no").alias("start_line"), "end_line", F.trim("text").alias("signature"), "confidence")


def _found(patterns) -> Column:
    """Definitions (line_no, kind, symbol) among `lines`, but those of `_hidden`, by the patterns of one language."""
    one = lambda x, i: F.struct((i + 1).alias("line_no"), F.when(~F.coalesce(F.get("_hidden", i), F.lit(False)), _hit(x, None, patterns)).alias("d"))
    hits = F.filter(F.transform("lines", one), lambda x: x["d"].isNotNull())
    return F.transform(hits, lambda x: F.struct(x["line_no"].alias("line_no"), x["d"]["kind"].alias("kind"), x["d"]["symbol"].alias("symbol")))


def symbols(files: DataFrame) -> DataFrame:
    """(id, start_line, signature, body) of the definitions in files (path, content), once each: the line where one begins, and
    the lines after it, up to its end.

    A file whose definitions end with braces is split into lines once, and all is found in its row; only of files where a
    definition is not closed before the next one begins the braces become rows. Others go through definitions()."""
    told = files.select("path", language(F.col("path")).alias("lang"), "content")
    rest = told.where(F.coalesce(~F.col("lang").isin(*BRACED), F.lit(True))).select("path", "content")
    held = hidden(told.where(F.col("lang").isin(*BRACED)).select("path", "lang", file_lines(F.col("content")).alias("lines")))
    found = F.lit(None).cast("array<struct<line_no:int,kind:string,symbol:string>>")
    for lang in BRACED:
        found = F.when(F.col("lang") == lang, _found([d for d in DEFINITIONS if lang in d[0].split()])).otherwise(found)
    held = once(held, _found=found).where(F.size("_found") > 0).withColumn("_starts", F.transform("_found", lambda x: x["line_no"]))
    held = closings(held)
    text = lambda x, e: F.struct(x["kind"].alias("kind"), x["symbol"].alias("symbol"), x["line_no"].alias("start_line"), F.get("lines", x["line_no"] - 1).alias("signature"), F.array_join(F.slice("lines", x["line_no"] + 1, e - x["line_no"]), "\n").alias("body"))
    texts = F.zip_with("_found", "_ends", text)
    held = settle(held.select("path", F.size("lines").alias("_last"), "_starts", "_b", F.when(F.col("_b").isNotNull(), F.col("_found")).alias("_found"), F.when(F.col("_b").isNull(), texts).alias("_texts")))
    told_texts, open_ = held.where("_b is null").select("path", "_texts"), held.where("_b is not null")
    if not open_.isEmpty():  # the files' texts are brought to them; where there are none, no text is shuffled
        ends = nested_ends(open_).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "end_line"))).alias("_e"))
        open_ = open_.select("path", "_found").join(ends, "path").join(files.select("path", file_lines(F.col("content")).alias("lines")), "path")
        told_texts = told_texts.unionByName(open_.withColumn("_ends", F.transform("_e", lambda x: x["end_line"])).select("path", texts.alias("_texts")))
    every = told_texts.select("path", F.explode("_texts").alias("x")).select("path", "x.*")
    every = every.select(_id().alias("id"), "start_line", "signature", "body")
    if rest.select("path").isEmpty():
        return every
    src = settle(source_lines(rest))
    return every.unionByName(bodies(definitions(src, files=rest).join(rest, "path"), F.col("content")).select("id", "start_line", "signature", "body"))


def import_targets(src: DataFrame) -> DataFrame:
    """(path, lang, line_no, text, target, file): what a line imports; relative targets are made paths and resolved among the files."""
    name = F.lit("")
    for langs, rx in reversed(IMPORTS):
        got = F.regexp_extract("text", rx, 1)
        name = F.when(F.col("lang").isin(*langs.split()) & (got != ""), got).otherwise(name)
    d = settle(src.withColumn("target", name)).where("target <> ''")
    folder = F.regexp_replace("path", "[^/]*$", "")
    full = F.concat(folder, "target")
    for _ in range(4):  # a/../ and ./ of a relative target
        full = F.regexp_replace(F.regexp_replace(full, r"(^|/)\./", "$1"), r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    module = F.regexp_replace("target", r"\.", "/")
    d = d.withColumn("raw", F.col("target")).withColumn("target", F.when(F.startswith("target", F.lit(".")) & (F.col("lang") != "python"), full).when(F.col("lang").isin("python", "java"), module).otherwise(F.col("target")))
    files = src.groupBy("path").agg(F.lit(0).alias("seq")).withColumn("seq", F.col("path"))
    js = resolve_imports(d, files)
    java = files.select(F.regexp_replace("path", r"\.java$", "").alias("_k"), F.col("path").alias("_f"))
    other = js.where("lang <> 'python'").join(java, F.col("target") == F.col("_k"), "left").withColumn("file", F.coalesce("file", "_f")).drop("_k", "_f")
    python = binding.suffix_modules(js.where("lang = 'python'").drop("file").withColumn("_tail", F.concat("target", F.lit(".py"))), files, "_tail").drop("_tail")
    return other.unionByName(python)


def calls(src: DataFrame, defs: DataFrame) -> DataFrame:
    """(caller, path, receiver, name, line_no, text): calls in the lines of each function, from two lines above it on, as
    surveyed; nested functions both scan."""
    fn = defs.where("kind in ('Function', 'Method')").select(F.col("id").alias("caller"), "path", "symbol", F.greatest(F.col("start_line") - 2, F.lit(1)).alias("low"), F.col("end_line").alias("high"))
    d = binding.called(src).where(~F.col("name").isin(*NOT_CALLS)).withColumn("at", F.col("line_no"))
    return intervals.stab(d, fn, ["path"]).where("name <> symbol").select("caller", "path", "receiver", "name", "line_no", "text")


def tests(src: DataFrame) -> DataFrame:
    """(id, name, path, line_no) of tests in test files."""
    name = F.coalesce(*(F.nullif(F.regexp_extract("text", TEST, i), F.lit("")) for i in (1, 2, 3)))
    d = src.where(is_test(F.col("path"))).withColumn("name", name).where("name is not null")
    return d.select(F.concat(F.lit("test:"), "path", F.lit(":"), F.regexp_replace("name", r"\s+", "_")).alias("id"), "name", "path", "line_no")


def _edges(d: DataFrame, kind, src, dst, confidence) -> DataFrame:
    d = d.select(src.alias("src"), dst.alias("dst"), kind.alias("type"), evidence(F.col("path"), F.col("line_no"), F.col("text")).alias("evidence"), F.array(F.lit("parser")).alias("sources"), F.lit(confidence).cast("double").alias("confidence"), F.lit(False).alias("conflict"))
    return d.select(edge_id(F.col("src"), F.col("dst"), F.col("type")).alias("id"), "*")


def _enclosing(src: DataFrame, defs: DataFrame) -> DataFrame:
    """Lines with the innermost function around them (owner), or the file."""
    fn = defs.where("kind in ('Function', 'Method')").select(F.col("id").alias("owner"), "path", F.col("start_line").alias("low"), F.col("end_line").alias("high"))
    best = intervals.innermost(src.select("path", F.col("line_no").alias("at")), fn, ["path"], "owner").withColumnRenamed("at", "line_no")
    return src.join(best, ["path", "line_no"], "left").withColumn("owner", F.coalesce("owner", F.concat(F.lit("file:"), "path")))


def bound(src: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(names, modules, instances) that the files bind, as binding.resolve() takes them; imports is import_targets()."""
    every = settle(binding.bindings(src).withColumn("seq", F.struct("line_no", "pos")))
    to = imports.groupBy("path", "line_no").agg(F.min("file").alias("file"))
    known = every.where("way <> 'instance'").join(to, ["path", "line_no"], "left").withColumn("package", F.when(F.col("file").isNull() & ~F.startswith("target", F.lit(".")), F.col("target")))
    known = settle(known.withColumn("package", F.regexp_extract("package", r"^(@[^/]+/[^/]+|[^/]+)", 1)))
    names = known.where("way = 'named'").select("path", "local", "name", "file", "package", "seq")
    return names, known.where("way = 'space'").select("path", "local", "file", "package", "seq"), every.where("way = 'instance'").select("path", "local", F.col("name").alias("class"), "seq")


def parse(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of source files (path, content): one closed graph, the first evidence of each edge."""
    src = settle(source_lines(files))  # written between the passes, as each is read many times
    defs = settle(definitions(src, files=files))
    named = lambda d, kind: d.select("id", F.lit(kind).alias("kind"), "name", "path")
    nodes = files.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("File").alias("kind"), F.substring_index("path", "/", -1).alias("name"), "path", language(F.col("path")).alias("lang"))
    nodes = nodes.unionByName(defs.select("id", "kind", F.col("symbol").alias("name"), "path", "lang", "signature", "start_line", "end_line"), allowMissingColumns=True)
    t = tests(src)
    nodes = nodes.unionByName(named(t, "Test"), allowMissingColumns=True)
    at = lambda d: F.concat(F.lit("file:"), d["path"])
    d = defs.withColumnsRenamed({"start_line": "line_no", "signature": "text"})
    edges = _edges(d, F.lit("CONTAINS"), at(d), F.col("id"), 1.0)
    imp = settle(import_targets(src))
    local = imp.where("file is not null and file <> path")
    edges = edges.unionByName(_edges(local, F.lit("IMPORTS"), at(local), F.concat(F.lit("file:"), "file"), 1.0))
    away = imp.where("file is null and lang <> 'python' and not startswith(raw, '.')")
    package = F.regexp_extract("raw", r"^(@[^/]+/[^/]+|[^/]+)", 1)
    edges = edges.unionByName(_edges(away, F.lit("IMPORTS"), at(away), F.concat(F.lit("ext:"), package), 1.0))
    scripts = src.where(F.col("lang").isin("typescript", "javascript", "python"))
    found = settle(calls(scripts, defs.where(F.col("lang").isin("typescript", "javascript", "python"))))
    known = defs.where("kind in ('Function', 'Method', 'Class')").select("symbol", "path", "id", F.col("start_line").alias("seq"))
    c = settle(binding.resolve(found, known, *bound(scripts, imp)))
    first = c.groupBy("caller", "callee").agg(F.min_by(F.struct("path", "line_no", "text", "confidence"), F.struct("line_no", F.col("name"), F.coalesce("receiver", F.lit("")))).alias("e")).select("caller", "callee", "e.*")
    edges = edges.unionByName(_edges(first, F.lit("CALLS"), F.col("caller"), F.col("callee"), 1.0).drop("confidence").join(first.select(F.col("caller").alias("src"), F.col("callee").alias("dst"), "confidence"), ["src", "dst"]).select(*edges.columns))
    checks = intervals.first_before(c.where(is_test(F.col("path")) & ~F.startswith("callee", F.lit("ext:"))).withColumn("at", F.col("line_no")), t.select("path", F.col("line_no").alias("at"), F.col("id").alias("test")), ["path"], "test")
    checks = checks.withColumn("test", F.coalesce("test", F.concat(F.lit("test:"), "path", F.lit(":file"))))
    nodes = nodes.unionByName(checks.where("test = concat('test:', path, ':file')").select(F.col("test").alias("id"), F.lit("Test").alias("kind"), F.substring_index("path", "/", -1).alias("name"), "path").distinct(), allowMissingColumns=True)
    edges = edges.unionByName(_edges(checks, F.lit("TESTS"), F.col("test"), F.col("callee"), 0.85))
    body = settle(_enclosing(src, defs))
    x = lambda rx, i: F.nullif(F.regexp_extract("text", rx, i), F.lit(""))
    route = body.withColumn("_h", x(ROUTE, 3)).where("_h is not null").withColumn("api", F.concat(F.lit("api:"), F.upper(x(ROUTE, 1)), F.lit(":"), x(ROUTE, 2)))
    deco = src.withColumn("_m", x(DECORATOR, 1)).where("_m is not null").withColumn("api", F.concat(F.lit("api:"), F.when(F.lower("_m") == "route", "GET").otherwise(F.upper("_m")), F.lit(":"), x(DECORATOR, 2)))
    follow = defs.where("kind in ('Function', 'Method')").select("path", "id", F.col("start_line").alias("_s"))
    deco = deco.join(follow, "path").where("_s > line_no").groupBy("path", "line_no", "text", "api").agg(F.min_by("id", "_s").alias("handler"))
    api = route.select("api", "path").union(deco.select("api", "path")).distinct()
    nodes = nodes.unionByName(api.select(F.col("api").alias("id"), F.lit("API").alias("kind"), F.regexp_replace("api", "^api:", "").alias("name"), "path"), allowMissingColumns=True)
    handler = route.join(follow.select("id", "path").withColumn("_h", F.substring_index("id", ":", -1)), ["path", "_h"])
    edges = edges.unionByName(_edges(handler, F.lit("EXPOSES"), F.col("id"), F.col("api"), 1.0)).unionByName(_edges(deco, F.lit("EXPOSES"), F.col("handler"), F.col("api"), 0.95))
    w = body.withColumn("table", F.coalesce(x(WRITES, 1), x(WRITES, 2), x(WRITES, 3)))
    edges = edges.unionByName(_edges(w.where("table is not null"), F.lit("WRITES"), F.col("owner"), F.concat(F.lit("table:"), "table"), 0.9))
    r = w.where("table is null").withColumn("table", x(READS, 1)).where("table is not null")
    edges = edges.unionByName(_edges(r, F.lit("READS"), F.col("owner"), F.concat(F.lit("table:"), "table"), 0.75))
    p = body.withColumn("table", x(PRISMA, 1)).where("table is not null")
    edges = edges.unionByName(_edges(p, F.when(F.startswith(x(PRISMA, 2), F.lit("find")), "READS").otherwise("WRITES"), F.col("owner"), F.concat(F.lit("table:"), "table"), 0.92))
    ev = body.withColumn("event", x(EVENT, 2)).where("event is not null")
    edges = edges.unionByName(_edges(ev, F.when(x(EVENT, 1) == "subscribe", "SUBSCRIBES").otherwise("PUBLISHES"), F.col("owner"), F.concat(F.lit("event:"), "event"), 0.85))
    nodes = nodes.unionByName(ev.select(F.concat(F.lit("event:"), "event").alias("id"), F.lit("Event").alias("kind"), F.col("event").alias("name")).distinct(), allowMissingColumns=True)
    tables = w.where("table is not null").select("table").union(r.select("table")).union(p.select("table")).distinct()
    nodes = nodes.unionByName(tables.select(F.concat(F.lit("table:"), "table").alias("id"), F.lit("Table").alias("kind"), F.col("table").alias("name")), allowMissingColumns=True)
    nodes = nodes.groupBy("id").agg(F.max_by(F.struct(*[c for c in nodes.columns if c != "id"]), F.coalesce("start_line", F.lit(0))).alias("r")).select("id", "r.*")
    edges = edges.groupBy("id").agg(F.min_by(F.struct(*[c for c in edges.columns if c != "id"]), F.col("evidence")[0]["line"]).alias("r")).select("id", "r.*")
    return close_graph(settle(nodes), settle(edges))
