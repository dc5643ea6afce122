"""Repositories and packages of workspaces, the nearest root above a path, ignore files in any folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.ids import basename, edge_id
from skein.operators.loops import settle

# Folders that are not looked into, folders that packages lie in where nothing declares them, languages by file ending.
CLOSED = ("node_modules", "dist", "build")
USUAL = ("packages", "apps", "services", "libs", "modules", "workspaces")
SNIFFED = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python", ".java": "java", ".go": "go", ".rs": "rust",
    ".rb": "ruby", ".php": "php", ".cs": "csharp", ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".cpp": "cpp", ".c": "c",
}


def above(path: Column) -> Column:
    """The folders above a path, the top ('') first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def nearest(paths: DataFrame, roots: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """paths (path, ...) with root: the deepest of roots (root) that is the path or lies above it, else null.

    keys are columns of both that have to agree. Only distinct folders meet the roots, by equality with one of the folders above
    them: work grows with folders times their depth, never with paths times roots. A path that is a root itself is its own."""
    keys = keys or []
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    d = paths.withColumn("_dir", folder)
    dirs = d.select(*keys, "_dir").distinct()
    each = dirs.select(*keys, "_dir", F.explode(F.array_union(above(F.col("_dir")), F.array("_dir"))).alias("root"))
    met = each.join(roots.select(*keys, "root").distinct(), [*keys, "root"]).groupBy(*keys, "_dir").agg(F.max_by("root", F.length("root")).alias("_up"))
    own = roots.select(*keys, F.col("root").alias("path"), F.col("root").alias("_own")).distinct()
    j = d.join(met, [*keys, "_dir"], "left").join(own, [*keys, "path"], "left")
    return j.withColumn("root", F.coalesce("_own", "_up")).drop("_dir", "_up", "_own").select(*paths.columns, "root")


def git_roots(files: DataFrame, depth: int = 4) -> DataFrame:
    """(workspace, root): folders with a .git in them down to the depth given; none inside another, nor in closed folders."""
    at = F.regexp_extract("path", r"^(?:(.*?)/)?\.git(?:/|$)", 1)
    f = files.where(F.rlike("path", F.lit(r"(^|/)\.git(/|$)"))).select("workspace", at.alias("root")).distinct()
    deep = F.when(F.col("root") == "", 0).otherwise(F.size(F.split("root", "/")))
    f = f.where((deep <= depth) & ~F.exists(F.split("root", "/"), lambda s: s.isin(*CLOSED)))
    upper = f.select("workspace", F.col("root").alias("_up"))
    each = f.where("root <> ''").select("workspace", "root", F.explode(above(F.col("root"))).alias("_up"))
    return f.join(each.join(upper, ["workspace", "_up"]).select("workspace", "root"), ["workspace", "root"], "left_anti")


def monorepos(files: DataFrame) -> DataFrame:
    """(workspace, type, packages): the first kind of monorepo that a workspace's top folder declares; else two packages or more in usual folders.

    files: (workspace, path, content). A declaration without packages still decides the kind. Patterns are not expanded."""
    top = lambda name: F.col("path") == name
    js = lambda p: F.get_json_object("content", p)
    names = lambda c: F.from_json(c, "array<string>")
    keys = lambda c: F.coalesce(names(c), F.map_keys(F.from_json(c, "map<string,string>")))
    none = F.array().cast("array<string>")
    ok = F.try_parse_json("content").isNotNull()
    npm = F.coalesce(names(js("$.workspaces")), names(js("$.workspaces.packages")), none)
    pnpm = F.filter(F.transform(F.filter(F.split("content", "\n"), lambda x: x.contains(":")), lambda x: F.regexp_replace(F.trim(F.get(F.split(x, ":"), F.lit(1))), "['\"]", "")), lambda x: x != "")
    rush = F.transform(F.from_json(js("$.projects"), "array<struct<projectFolder:string,path:string>>"), lambda p: F.coalesce(F.nullif(p["projectFolder"], F.lit("")), p["path"]))
    kinds = [
        ("npm-workspaces", top("package.json") & ok & js("$.workspaces").isNotNull(), npm), ("turborepo", top("turbo.json") & ok, F.coalesce(names(js("$.projects")), names(js("$.packages")), none)),
        ("nx", top("nx.json") & ok, F.coalesce(keys(js("$.projects")), none)), ("lerna", top("lerna.json") & ok, F.coalesce(names(js("$.packages")), F.array(F.lit("packages/*")))),
        ("pnpm", top("pnpm-workspace.yaml"), pnpm), ("rush", top("rush.json") & ok, F.coalesce(rush, none)),
    ]
    found = F.lit(None).cast("struct<rank:int,type:string,packages:array<string>>")
    for i, (kind, holds, packages) in reversed(list(enumerate(kinds))):
        found = F.when(holds, F.struct(F.lit(i).alias("rank"), F.lit(kind).alias("type"), packages.alias("packages"))).otherwise(found)
    told = files.where(top("package.json") | F.col("path").isin("turbo.json", "nx.json", "lerna.json", "pnpm-workspace.yaml", "rush.json"))
    told = told.withColumn("f", found).where("f is not null").groupBy("workspace").agg(F.min_by("f", "f.rank").alias("f")).select("workspace", "f.type", "f.packages")
    usual = files.where(F.rlike("path", F.lit(rf"^({'|'.join(USUAL)})/[^/]+/package\.json$"))).select("workspace", F.regexp_replace("path", "/package.json$", "").alias("p"))
    usual = usual.groupBy("workspace").agg(F.array_sort(F.collect_set("p")).alias("packages")).where(F.size("packages") >= 2).select("workspace", F.lit("unknown").alias("type"), "packages")
    return told.unionByName(usual.join(told, "workspace", "left_anti"))


def repositories(files: DataFrame, depth: int = 4) -> DataFrame:
    """(workspace, root, name, package, version, languages, is_main, monorepo) of (workspace, path, content).

    Declared packages whose folder holds a file, git roots, and the top folder where it has a .git or a package.json. is_main: the
    top folder, and the first of the others (packages in their order, then git roots by name). Languages are those of the
    files of a folder and of the folders in it. A null or broken package.json names nothing."""
    files = files.where("path is not null")
    mono, git = settle(monorepos(files)), settle(git_roots(files, depth))
    folders = files.select("workspace", F.explode(above(F.col("path"))).alias("root")).distinct()
    packed = mono.select("workspace", F.posexplode("packages").alias("i", "root")).select("workspace", F.regexp_replace("root", r"^\./|/+$", "").alias("root"), F.struct(F.lit(0).alias("a"), F.col("i"), F.lit("").alias("r")).alias("o"))
    top = git.where("root = ''").select("workspace").union(files.where("path = 'package.json'").select("workspace")).distinct()
    every = packed.unionByName(git.select("workspace", "root", F.struct(F.lit(1).alias("a"), F.lit(0).alias("i"), F.col("root").alias("r")).alias("o")))
    every = every.unionByName(top.select("workspace", F.lit("").alias("root"), F.struct(F.lit(2).alias("a"), F.lit(0).alias("i"), F.lit("").alias("r")).alias("o")))
    every = settle(every.groupBy("workspace", "root").agg(F.min("o").alias("o")).join(folders, ["workspace", "root"], "left_semi"))
    first = F.col("o") == F.min("o").over(Window.partitionBy("workspace"))
    manifest = files.where(F.rlike("path", F.lit(r"(^|/)package\.json$"))).select("workspace", F.regexp_replace("path", r"/?package\.json$", "").alias("root"), F.get_json_object("content", "$.name").alias("package"), F.get_json_object("content", "$.version").alias("version"))
    table = F.create_map(*(F.lit(x) for kv in SNIFFED.items() for x in kv))
    lang = F.try_element_at(table, F.regexp_extract(F.lower(basename(F.col("path"))), r"(\.[^.]+)$", 1))
    inner = F.regexp_replace("path", "/?[^/]*$", "")
    seen = files.select("workspace", lang.alias("l"), inner.alias("d")).where("l is not null").distinct()
    up = F.when(F.col("d") != "", F.regexp_replace("d", "/?[^/]*$", ""))
    shut = basename(F.col("d")).isin(*CLOSED, ".git")
    seen = seen.select("workspace", "l", F.explode(F.filter(F.array(F.col("d"), F.when(~shut, up)), lambda x: x.isNotNull())).alias("root"))
    sniffed = seen.join(every.select("workspace", "root"), ["workspace", "root"], "left_semi").groupBy("workspace", "root").agg(F.array_sort(F.collect_set("l")).alias("languages"))
    d = every.withColumn("is_main", first | (F.col("root") == "")).join(manifest, ["workspace", "root"], "left").join(sniffed, ["workspace", "root"], "left").join(mono.select("workspace", F.col("type").alias("monorepo")), "workspace", "left")
    name = F.coalesce(F.nullif(F.substring_index("package", "/", -1), F.lit("")), F.nullif(basename(F.col("root")), F.lit("")), basename(F.col("workspace")))
    return d.select("workspace", "root", name.alias("name"), "package", "version", F.coalesce("languages", F.array().cast("array<string>")).alias("languages"), "is_main", "monorepo")


def workspace_graph(files: DataFrame, repos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (Repo) and DEPENDS_ON edges between repositories of one workspace, by the names in their package.json."""
    id_ = F.concat(F.lit("repo:"), "name")
    nodes = repos.select("workspace", id_.alias("id"), F.lit("Repo").alias("kind"), "name", F.when(F.col("root") == "", ".").otherwise(F.col("root")).alias("path"))
    of = lambda k: F.coalesce(F.map_keys(F.from_json(F.get_json_object("content", f"$.{k}"), "map<string,string>")), F.array().cast("array<string>"))
    deps = F.array_union(F.array_union(of("dependencies"), of("devDependencies")), of("peerDependencies"))
    asked = files.where(F.rlike("path", F.lit(r"(^|/)package\.json$"))).select("workspace", F.regexp_replace("path", r"/?package\.json$", "").alias("root"), F.explode(deps).alias("package"))
    asked = asked.join(repos.select("workspace", "root", id_.alias("src")), ["workspace", "root"])
    target = repos.where("package is not null").groupBy("workspace", "package").agg(F.max_by(id_, "root").alias("dst"))
    d = asked.join(target, ["workspace", "package"]).where("src <> dst").select("workspace", "src", "dst", "package").distinct()
    note = F.array(F.struct(F.lit("workspace").alias("file"), F.lit(0).alias("line"), F.concat(F.lit("package.json dependency: "), "package").alias("snippet")))
    return nodes, d.select("workspace", edge_id(F.col("src"), F.col("dst"), F.lit("DEPENDS_ON")).alias("id"), F.lit("DEPENDS_ON").alias("type"), "src", "dst", note.alias("evidence"), F.array(F.lit("parser")).alias("sources"), F.lit(0.95).alias("confidence"), F.lit(False).alias("conflict"))


def ignore_rules(files: DataFrame) -> DataFrame:
    """(folder, line_no, keep, regex) of ignore files (path, content) in any folder; regex is for paths relative to the folder.

    A pattern with a slash before its end is for that folder alone, any other for the folders below too."""
    d = files.where(F.rlike("path", F.lit(r"(^|/)\.[a-z]*ignore$"))).select(F.regexp_replace("path", "/?[^/]*$", "").alias("folder"), F.posexplode(F.split("content", "\r?\n")).alias("line_no", "p"))
    d = d.withColumn("p", F.trim("p")).where((F.col("p") != "") & ~F.startswith("p", F.lit("#")))
    keep = F.startswith("p", F.lit("!"))
    open_ = F.regexp_replace(F.when(keep, F.substring("p", 2, 1 << 20)).otherwise(F.col("p")), "/+$", "")
    bare = F.regexp_replace(open_, "^/+", "")
    out = F.regexp_replace(bare, r"([.+^$(){}|\\\[\]])", r"\\$1")
    out = F.replace(F.replace(F.replace(F.replace(out, F.lit("**"), F.lit("\x01")), F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]")), F.lit("\x01"), F.lit(".*"))
    return d.select("folder", "line_no", keep.alias("keep"), F.concat(F.when(open_.contains("/"), "^").otherwise("(^|/)"), out, F.lit("(/|$)")).alias("regex")).where(bare != "")


def not_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files (path, ...) that the last rule to match does not leave out; rules of deeper folders come after those above them.

    A path meets the rules of the folders above it alone, by equality. A path that no rule matches stays."""
    each = files.select("path").distinct().select("path", F.explode(above(F.col("path"))).alias("folder"))
    hit = each.join(rules, "folder").withColumn("_rest", F.when(F.col("folder") == "", F.col("path")).otherwise(F.expr("substring(path, length(folder) + 2)")))
    hit = hit.where(F.expr("rlike(_rest, regex)"))
    last = hit.groupBy("path").agg(F.max_by("keep", F.struct(F.length("folder"), "line_no")).alias("_keep"))
    return files.join(last.where("not _keep").select("path"), "path", "left_anti")
