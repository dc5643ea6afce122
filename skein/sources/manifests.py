"""Manifests, reports and specifications as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.sources.files import lines

# Fixed value: paths that are no sources.
SKIP_PATH = r"(?i)(?:^|/)(?:package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|Cargo\.lock|Gemfile\.lock)$|\.(?:map|min\.js)$"


def packages(files: DataFrame) -> DataFrame:
    """(path, name, dependency, version) of package.json (dependencies, peerDependencies) and composer.json (require, require-dev)."""
    of = lambda field: F.coalesce(F.from_json(F.get_json_object("content", f"$['{field}']"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    name = F.get_json_object("content", "$.name")
    npm = files.where(F.rlike("path", F.lit(r"(^|/)package\.json$"))).select("path", name.alias("name"), F.explode(F.map_entries(of("dependencies"))).alias("d"))
    npm = npm.unionByName(files.where(F.rlike("path", F.lit(r"(^|/)package\.json$"))).select("path", name.alias("name"), F.explode(F.map_entries(of("peerDependencies"))).alias("d")))
    php = files.where(F.rlike("path", F.lit(r"(^|/)composer\.json$")))
    php = php.select("path", name.alias("name"), F.explode(F.concat(F.map_entries(of("require")), F.map_entries(of("require-dev")))).alias("d")).where("d.key <> 'php'")
    return npm.unionByName(php).select("path", "name", F.col("d.key").alias("dependency"), F.col("d.value").alias("version")).distinct()


def lcov(files: DataFrame) -> DataFrame:
    """(file, line, hits): SF: names the file of the DA: lines after it."""
    d = lines(files)
    w = Window.partitionBy("path").orderBy("line_no")
    d = d.withColumn("file", F.last(F.when(F.startswith("text", F.lit("SF:")), F.substring("text", 4, 1 << 30)), True).over(w))
    da = F.split(F.substring("text", 4, 1 << 30), ",")
    return d.where(F.startswith("text", F.lit("DA:"))).select("file", F.get(da, F.lit(0)).try_cast("int").alias("line"), F.get(da, F.lit(1)).try_cast("int").alias("hits")).where("hits is not null")


def istanbul(files: DataFrame) -> DataFrame:
    """(file, line, hits) of statements hit."""
    schema = "map<string,struct<statementMap:map<string,struct<start:struct<line:int>>>,s:map<string,int>>>"
    d = files.select(F.explode(F.from_json("content", schema)).alias("file", "r"))
    d = d.select("file", "r.statementMap", F.explode("r.s").alias("k", "hits")).where("hits > 0")
    return d.select("file", F.try_element_at("statementMap", "k")["start"]["line"].alias("line"), "hits").where("line is not null")


def git_log(log: DataFrame, most: int | None = None, block: int = 100_000) -> DataFrame:
    """(commit, file) of a log (line_no, text) in which COMMIT_<hash> lines stand before their files' names; of the first `most` commits.

    The last commit of each block of lines is carried into the blocks after it: one row a block, so that no task reads the log."""
    head = F.startswith(F.trim("text"), F.lit("COMMIT_"))
    d = log.withColumn("_b", F.floor(F.col("line_no") / block)).withColumn("_c", F.when(head, F.substring(F.trim("text"), 8, 1 << 30)))
    ends = d.groupBy("_b").agg(F.max_by("_c", F.when(F.col("_c").isNotNull(), F.col("line_no"))).alias("_c"), F.count("_c").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_b", F.last("_c", True).over(before).alias("_from"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_seen"))
    inside = Window.partitionBy("_b").orderBy("line_no")
    d = d.join(carried, "_b").withColumn("commit", F.coalesce(F.last("_c", True).over(inside), F.col("_from"))).withColumn("_k", F.col("_seen") + F.count("_c").over(inside))
    if most is not None:
        d = d.where(F.col("_k") <= most)
    return d.where(F.col("_c").isNull() & (F.trim("text") != "") & F.col("commit").isNotNull()).select("commit", F.trim("text").alias("file"))


def name_status(rows: DataFrame) -> DataFrame:
    """(status, path, old_path) of lines (text) of status, tab, path and, for renames and copies, the new path."""
    p = F.split("text", "\t")
    status = F.substring(F.get(p, F.lit(0)), 1, 1)
    moved = status.isin("R", "C")
    norm = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    d = rows.where(F.trim("text") != "").select(status.alias("status"), norm(F.when(moved, F.coalesce(F.get(p, F.lit(2)), F.get(p, F.lit(1)))).otherwise(F.get(p, F.lit(1)))).alias("path"), norm(F.when(moved, F.get(p, F.lit(1)))).alias("old_path"))
    return d.where(F.col("path").isNotNull() & (F.col("path") != "") & ~F.rlike("path", F.lit(SKIP_PATH)))


def owners(files: DataFrame) -> DataFrame:
    """(line, pattern, owners) of an owners file."""
    d = lines(files).withColumn("_p", F.split(F.trim("text"), r"\s+"))
    o = F.filter(F.slice("_p", 2, 1 << 20), lambda x: x.contains("@"))
    return d.where(~F.startswith(F.trim("text"), F.lit("#")) & (F.size(o) > 0)).select(F.col("line_no").alias("line"), F.get("_p", F.lit(0)).alias("pattern"), o.alias("owners"))


def openapi(files: DataFrame) -> DataFrame:
    """(path, method, route, operation, tags) of JSON specifications."""
    spec = files.where(F.rlike(F.lower("path"), F.lit("(openapi|swagger|api-spec|asyncapi)[^/]*$")))
    d = spec.select("path", F.explode(F.from_json(F.get_json_object("content", "$.paths"), "map<string,map<string,struct<operationId:string,summary:string,tags:array<string>>>>")).alias("route", "ops"))
    d = d.select("path", "route", F.explode("ops").alias("method", "op")).where(F.lower("method").isin("get", "post", "put", "patch", "delete", "options", "head"))
    return d.select("path", F.upper("method").alias("method"), "route", F.coalesce("op.operationId", "op.summary").alias("operation"), F.array_join("op.tags", ",").alias("tags"))


def protobuf(files: DataFrame) -> DataFrame:
    """(path, service, rpc, request, response)."""
    f = files.where(F.endswith("path", F.lit(".proto")))
    d = f.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?s)(service\s+\w+\s*\{.*?\n\})"), 1)).alias("s"))
    d = d.select("path", F.regexp_extract("s", r"service\s+(\w+)", 1).alias("service"), F.explode(F.regexp_extract_all("s", F.lit(r"(rpc\s+\w+\s*\(\s*(?:stream\s+)?[\w.]+\s*\)\s*returns\s*\(\s*(?:stream\s+)?[\w.]+\s*\))"), 1)).alias("r"))
    rx = r"rpc\s+(\w+)\s*\(\s*(?:stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(?:stream\s+)?([\w.]+)"
    return d.select("path", "service", *(F.regexp_extract("r", rx, i).alias(n) for i, n in ((1, "rpc"), (2, "request"), (3, "response"))))


def messages(files: DataFrame, min_fields: int = 2) -> DataFrame:
    """(path, message, fields) of protobuf messages with enough fields to be a table."""
    f = files.where(F.endswith("path", F.lit(".proto"))).select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?s)(message\s+\w+\s*\{[^{}]*\})"), 1)).alias("m"))
    return f.select("path", F.regexp_extract("m", r"message\s+(\w+)", 1).alias("message"), F.regexp_count("m", F.lit(r"(?m)^\s+\w+.*=\s*\d+")).cast("int").alias("fields")).where(F.col("fields") >= min_fields)


def compose(files: DataFrame) -> DataFrame:
    """(path, service, image, depends_on) of Compose files in JSON."""
    f = files.where(F.rlike("path", F.lit(r"(^|/)(docker-)?compose[^/]*\.json$")))
    one = "map<string,struct<image:string,depends_on:array<string>>>"
    d = f.select("path", F.explode(F.from_json(F.get_json_object("content", "$.services"), one)).alias("service", "s"))
    return d.select("path", "service", "s.image", F.array_join("s.depends_on", ",").alias("depends_on"))


def terraform(files: DataFrame) -> DataFrame:
    """(path, block, type, name) of resource and data blocks, and provider blocks (type null)."""
    f = files.where(F.rlike("path", F.lit(r"\.(tf|hcl)$")))
    d = f.select("path", F.explode(F.regexp_extract_all("content", F.lit(r'(?m)^((?:resource|data)\s+"\w+"\s+"\w+"\s*\{|provider\s+"\w+"\s*\{)'), 1)).alias("b"))
    two = F.regexp_extract("b", r'^(?:resource|data)\s+"(\w+)"', 1)
    return d.select("path", F.regexp_extract("b", r"^(\w+)", 1).alias("block"), F.nullif(two, F.lit("")).alias("type"), F.regexp_extract("b", r'"(\w+)"\s*\{$', 1).alias("name"))


def kubernetes(files: DataFrame) -> DataFrame:
    """(path, kind, name, image) of JSON objects with a kind."""
    f = files.where(F.endswith("path", F.lit(".json")) & F.get_json_object("content", "$.kind").isNotNull())
    images = F.from_json(F.coalesce(F.get_json_object("content", "$.spec.template.spec.containers"), F.get_json_object("content", "$.spec.containers")), "array<struct<image:string>>")
    return f.select("path", F.get_json_object("content", "$.kind").alias("kind"), F.get_json_object("content", "$.metadata.name").alias("name"), F.explode_outer(F.transform(images, lambda c: c["image"])).alias("image"))


def markdown_titles(files: DataFrame) -> DataFrame:
    """(path, title): the first heading, else the file's name."""
    f = files.where(F.endswith("path", F.lit(".md")))
    t = F.trim(F.regexp_extract("content", r"(?m)^#\s+(.+)$", 1))
    return f.select("path", F.coalesce(F.nullif(t, F.lit("")), F.substring_index("path", "/", -1)).alias("title"))


def seed(parsed: dict, spark) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(services, pins, critical) of a parsed seed file: (name, path), (src, dst, type), (id)."""
    services = spark.createDataFrame([(s["name"], s.get("path")) for s in parsed.get("services", [])], "name string, path string")
    pins = spark.createDataFrame([(p["from"], p["to"], p.get("type", "DEPENDS_ON")) for p in parsed.get("pins", [])], "src string, dst string, type string")
    return services, pins, spark.createDataFrame([(c,) for c in parsed.get("critical", [])], "id string")


def mark_critical(nodes: DataFrame, critical: DataFrame) -> DataFrame:
    """Adds the tag critical to the nodes listed."""
    j = nodes.join(critical.select("id", F.lit(True).alias("_c")).distinct(), "id", "left")
    base = F.coalesce("tags", F.array().cast("array<string>"))
    return j.withColumn("tags", F.when(F.col("_c"), F.array_union(base, F.array(F.lit("critical")))).otherwise(F.col("tags"))).drop("_c")
