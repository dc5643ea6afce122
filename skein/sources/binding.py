"""What names in a file stand for, and which definition a call means.

Bindings are rows: names imported from a module, aliases of whole modules, variables that hold an instance. A call with a
receiver is resolved through the variable's class or the module behind the alias; a call without one through the file's own
definitions, imported names, modules imported whole, and names that one file alone defines. Each step is an equi-join on
(path, name) with one row a key on its right side, so that a name called often is no group of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Import statements; the first that matches a line counts.
NAMED = r"import\s+\{\s*([^}]+)\s*\}\s+from\s+['\"]([^'\"]+)['\"]"
DEFAULT = r"import\s+(\w+)\s+from\s+['\"]([^'\"]+)['\"]"
WHOLE = r"import\s+\*\s+as\s+(\w+)\s+from\s+['\"]([^'\"]+)['\"]"
REQUIRED = r"(?:const|let|var)\s+(\w+)\s*=\s*require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"
PY_FROM = r"^from\s+(\S+)\s+import\s+(.+)$"
PY_WHOLE = r"^import\s+(\S+)(?:\s+as\s+(\w+))?$"
INSTANCE = r"(?:const|let|var)\s+(\w+)\s*=\s*new\s+(\w+)"
# Calls of Class.name( or object.name(, .name(, name(
CALL = r"\b[A-Za-z]\w*\.\w+\s*\(|\.\w+\s*\(|\b[a-zA-Z_]\w*\s*\("
# How sure each way to a callee is.
SURE = {"own": 1.0, "own_class": 0.9, "other_class": 0.8, "named": 0.95, "space": 0.95, "external": 0.8, "inside": 0.9, "unique": 0.75}

SCRIPT = ("typescript", "javascript")


def _part(rx: str, i: int) -> Column:
    return F.regexp_extract(F.trim("text"), rx, i)


def bindings(src: DataFrame) -> DataFrame:
    """(path, line_no, pos, way, local, name, target) of src (path, lang, line_no, text): ways named, space, instance.

    name is what the module calls it ('default' for a default import); target the module as written, or the class."""
    js, py = F.col("lang").isin(*SCRIPT), F.col("lang") == "python"
    names = F.when(js & (_part(NAMED, 2) != ""), _part(NAMED, 1)).when(py & (_part(PY_FROM, 1) != ""), _part(PY_FROM, 2))
    one = lambda way, local, name, target: F.array(F.struct(F.lit(way).alias("way"), local.alias("local"), name.alias("name"), target.alias("target")))
    listed = F.transform(
        F.filter(F.transform(F.split(names, ","), lambda x: F.trim(x)), lambda x: x != ""),
        lambda x: F.struct(F.lit("named").alias("way"), F.trim(F.element_at(F.split(x, r"\s+as\s+"), -1)).alias("local"), F.trim(F.split(x, r"\s+as\s+")[0]).alias("name"), F.when(js, _part(NAMED, 2)).otherwise(_part(PY_FROM, 1)).alias("target")),
    )
    alias = F.when(_part(PY_WHOLE, 2) != "", _part(PY_WHOLE, 2)).otherwise(F.substring_index(_part(PY_WHOLE, 1), ".", -1))
    found = (
        F.when(names.isNotNull(), listed)
        .when(js & (_part(DEFAULT, 1) != ""), one("named", _part(DEFAULT, 1), F.lit("default"), _part(DEFAULT, 2)))
        .when(js & (_part(WHOLE, 1) != ""), one("space", _part(WHOLE, 1), F.lit("*"), _part(WHOLE, 2)))
        .when(js & (_part(REQUIRED, 1) != ""), one("space", _part(REQUIRED, 1), F.lit("*"), _part(REQUIRED, 2)))
        .when(py & (_part(PY_WHOLE, 1) != ""), one("space", alias, F.lit("*"), _part(PY_WHOLE, 1)))
        .when(js & (_part(INSTANCE, 1) != ""), one("instance", _part(INSTANCE, 1), _part(INSTANCE, 2), _part(INSTANCE, 2)))
    )
    likely = src.where(F.rlike("text", F.lit(r"\b(?:import|require|new)\b")))
    return likely.select("path", "line_no", F.posexplode(found).alias("pos", "b")).select("path", "line_no", "pos", "b.*").where("local <> ''")


def called(src: DataFrame) -> DataFrame:
    """(path, line_no, text, receiver, name): each call once a line; receiver is null for bare calls and for .name()."""
    d = src.select("path", "line_no", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({CALL})"), 1))).alias("_m"))
    return d.select("path", "line_no", "text", F.nullif(F.regexp_extract("_m", r"^([A-Za-z]\w*)\.", 1), F.lit("")).alias("receiver"), F.regexp_extract("_m", r"(\w+)\s*\($", 1).alias("name")).distinct()


def suffix_modules(targets: DataFrame, files: DataFrame, target: str = "target") -> DataFrame:
    """targets with `file`: the first file (by seq) of files (path, seq) whose path ends with the target, else null.

    Each distinct path is written once for each of its tails, and meets the targets that are asked for by an equi-join; the
    first is a minimum, combined before the shuffle. Tails are many times what their table's size tells, so both joins are
    merges: neither side is ever sent through the driver. A null or empty target has no file."""
    asked = targets.where(F.col(target) != "").select(F.col(target).alias("_t")).distinct()
    once = files.groupBy("path").agg(F.min(F.struct("seq"))["seq"].alias("seq"))
    tails = once.select("path", "seq", F.explode(F.transform(F.sequence(F.lit(1), F.length("path")), lambda i: F.substring(F.col("path"), i, F.length("path")))).alias("_t")).where("path <> ''")
    first = tails.hint("merge").join(asked, "_t").groupBy("_t").agg(F.min(F.struct("seq", "path")).alias("_f")).select("_t", F.col("_f.path").alias("file"))
    return targets.join(first.hint("merge"), targets[target] == first["_t"], "left").drop("_t")


def _function(path: Column, name: Column) -> Column:
    return F.concat(F.lit("fn:"), path, F.lit(":"), name)


def _row(ok: Column, callee: Column, way: str) -> Column:
    return F.when(ok, F.struct(callee.alias("callee"), F.lit(SURE[way]).alias("confidence"), F.lit(way).alias("way")))


def resolve(calls: DataFrame, definitions: DataFrame, named: DataFrame, spaces: DataFrame, instances: DataFrame) -> DataFrame:
    """calls (path, receiver, name and more columns) with callee, confidence and way; unresolved calls go.

    definitions (symbol, path, id, seq): of a file's equal symbols the last counts. named (path, local, name, file, package,
    seq) and instances (path, local, class, seq): the last counts; spaces (path, local, file, package, seq): the first. file
    is null for modules outside the repository. A null name or path is unresolved; the order of equal seq is that of the values."""
    own = definitions.groupBy("path", "symbol").agg(F.max(F.struct("seq", "id"))["id"].alias("id"))
    alone = own.groupBy("symbol").agg(F.count("*").alias("n"), F.max("id").alias("id"), F.max("path").alias("path")).where("n = 1").drop("n")
    last = lambda d, *cols: d.groupBy("path", "local").agg(F.max(F.struct("seq", *cols)).alias("b")).select("path", "local", *(F.col(f"b.{c}") for c in cols))
    imported = last(named, "name", "file", "package").select("path", F.col("local").alias("name"), F.col("name").alias("_as"), F.col("file").alias("_file"), F.col("package").alias("_package"))
    modules = spaces.groupBy("path", "local").agg(F.min(F.struct("seq", "file", "package")).alias("b")).select("path", F.col("local").alias("receiver"), F.col("b.file").alias("_mfile"), F.col("b.package").alias("_mpackage"))
    held = last(instances, "class").select("path", F.col("local").alias("receiver"), F.col("class").alias("_class"))

    through = calls.where("receiver is not null").join(held, ["path", "receiver"], "left").join(modules, ["path", "receiver"], "left")
    through = through.join(own.select("path", F.col("symbol").alias("_class"), F.lit(True).alias("_mine")), ["path", "_class"], "left")
    through = through.join(alone.select(F.col("symbol").alias("_class"), F.col("path").alias("_cfile")), "_class", "left")
    name = F.col("name")
    found = F.coalesce(
        _row(F.col("_mine"), _function(F.col("path"), name), "own_class"), _row(F.col("_cfile").isNotNull(), _function(F.col("_cfile"), name), "other_class"),
        _row(F.col("_mfile").isNotNull(), _function(F.col("_mfile"), name), "space"), _row(F.col("_mpackage").isNotNull(), F.concat(F.lit("ext:"), "_mpackage"), "external"),
    )
    through = through.withColumn("_r", found).select(*calls.columns, "_r.*")

    bare = calls.where("receiver is null").join(own.select("path", F.col("symbol").alias("name"), F.col("id").alias("_own")), ["path", "name"], "left").join(imported, ["path", "name"], "left")
    open_ = bare.where("_own is null and _as is null").select("path", "name").distinct()
    inside = open_.join(spaces.where("file is not null").select("path", "file", "seq"), "path").join(own.select(F.col("path").alias("file"), F.col("symbol").alias("name"), "id"), ["file", "name"])
    inside = inside.groupBy("path", "name").agg(F.min(F.struct("seq", "id"))["id"].alias("_inside"))
    bare = bare.join(inside, ["path", "name"], "left").join(alone.select(F.col("symbol").alias("name"), F.col("id").alias("_unique")), "name", "left")
    found = F.coalesce(
        _row(F.col("_own").isNotNull(), F.col("_own"), "own"), _row(F.col("_file").isNotNull(), _function(F.col("_file"), F.col("_as")), "named"), _row(F.col("_package").isNotNull(), F.concat(F.lit("ext:"), "_package"), "external"),
        _row(F.col("_inside").isNotNull(), F.col("_inside"), "inside"), _row(F.col("_unique").isNotNull(), F.col("_unique"), "unique"),
    )
    bare = bare.withColumn("_r", found).select(*calls.columns, "_r.*")
    return through.unionByName(bare).where("callee is not null")
