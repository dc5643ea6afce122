"""Queries of workspaces, nearest roots, ignore files and scans over paths and files made from the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import scans
from skein.operators.loops import settle
from skein.plans.catalog import _read
from skein.plans.source_plans import _SPANS_SQL, _c, order_files
from skein.sources import workspaces
from skein.sources.files import lines


def _nearest(spark, sf_dir):
    l, s, p = (_read(spark, sf_dir, t) for t in ("lineitem", "supplier", "part"))
    paths = l.select(_c("s{}/p{}/o{}/x.ts", "l_suppkey", F.col("l_partkey") % 50, F.col("l_orderkey") % 20).alias("path")).distinct()
    roots = s.where("s_suppkey % 3 <> 0").select(_c("s{}", "s_suppkey").alias("root")).union(p.select(_c("s{}/p{}", F.col("p_partkey") % 100, F.col("p_partkey") % 50)))
    roots = roots.union(s.select(_c("s{}/p{}/o{}", "s_suppkey", F.col("s_suppkey") % 50, F.col("s_suppkey") % 20)))
    return workspaces.nearest(paths, roots)


_NEAREST_SQL = """with p as (select distinct 's' || l_suppkey || '/p' || (l_partkey % 50) || '/o' || (l_orderkey % 20) || '/x.ts' as path from lineitem),
 r as (select 's' || s_suppkey as root from supplier where s_suppkey % 3 <> 0 union select 's' || (p_partkey % 100) || '/p' || (p_partkey % 50) from part
   union select 's' || s_suppkey || '/p' || (s_suppkey % 50) || '/o' || (s_suppkey % 20) from supplier),
 d as (select path, string_split(path, '/') as x from p), e as (select path, unnest([x[1], x[1] || '/' || x[2], x[1] || '/' || x[2] || '/' || x[3]]) as root from d),
 m as (select path, arg_max(root, length(root)) as root from e join r using (root) group by path)
 select path, root from p left join m using (path)"""


def workspace_files(spark, sf_dir):
    """(workspace, path, content): a package for each customer; every second nation declares four fifths of its packages."""
    c = _read(spark, sf_dir, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    text = F.translate(_c('\x02"name":"@n/c{}","version":"1.{}","dependencies":\x02"@n/c{}":"*","left":"1"\x03,"devDependencies":\x02"@n/c{}":"*"\x03\x03', k, k % 10, k + 5, k + 8), "\x02\x03", "{}")
    files = c.select(_c("n{}", n).alias("workspace"), _c("packages/c{}/package.json", k).alias("path"), text.alias("content"))
    files = files.unionByName(files.select("workspace", F.replace("path", F.lit("package.json"), F.lit("src/a.ts")).alias("path"), F.lit("").alias("content")))
    listed = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"packages/c'), k.cast("string"), F.lit('"')))), ",")
    top = c.where("c_nationkey % 2 = 0 and c_custkey % 5 <> 0").groupBy("c_nationkey").agg(listed.alias("l"))
    return files.unionByName(top.select(_c("n{}", "c_nationkey").alias("workspace"), F.lit("package.json").alias("path"), F.concat(F.lit('{"name":"top","workspaces":['), "l", F.lit("]}")).alias("content")))


def _workspaces(part):
    def run(spark, sf_dir):
        files = settle(workspace_files(spark, sf_dir))
        repos = settle(workspaces.repositories(files))
        if part == "repos":
            return repos.select("workspace", "root", "name", "package", "version", F.array_join("languages", ",").alias("languages"), "is_main", "monorepo")
        return workspaces.workspace_graph(files, repos)[1].select("workspace", "src", "dst", "confidence")

    return run


_REPO_SQL = """with even as (select distinct c_nationkey as n from customer where c_nationkey % 2 = 0 and c_custkey % 5 <> 0),
 many as (select c_nationkey as n from customer where c_nationkey not in (select n from even) group by 1 having count(*) > 1),
 r as (select c_nationkey as n, c_custkey as k from customer where (c_nationkey in (select n from even) and c_custkey % 5 <> 0) or c_nationkey in (select n from many)) """
_REPOS_SQL = _REPO_SQL + """select 'n' || n as workspace, 'packages/c' || k as root, 'c' || k as name, '@n/c' || k as package, '1.' || (k % 10) as version, 'typescript' as languages,
   'packages/c' || k = min('packages/c' || k) over (partition by n) as is_main, case when n in (select n from even) then 'npm-workspaces' else 'unknown' end as monorepo from r
 union all select 'n' || n, '', 'top', 'top', null, '', true, 'npm-workspaces' from even"""


def _ignored(spark, sf_dir):
    l, s = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "supplier")
    end = F.when(F.col("l_linenumber") % 2 == 0, "log").otherwise("ts")
    paths = l.select(F.concat(_c("s{}/d{}/f{}.", "l_suppkey", F.col("l_partkey") % 9, F.col("l_orderkey") % 30), end).alias("path")).distinct()
    rules = s.where("s_suppkey % 4 = 0").select(_c("s{}/.gitignore", "s_suppkey").alias("path"), F.lit("!f1?.log\n/d5").alias("content"))
    rules = rules.union(s.limit(1).select(F.lit(".gitignore"), F.lit("# all\n*.log\nd3/\n!f7.log\n")))
    return workspaces.not_ignored(paths, workspaces.ignore_rules(rules))


_IGNORED_SQL = """with p as (select distinct l_suppkey as s, l_partkey % 9 as d, l_orderkey % 30 as f, l_linenumber % 2 = 0 as log from lineitem),
 q as (select *, 's' || s || '/d' || d || '/f' || f || case when log then '.log' else '.ts' end as path,
   case when s % 4 = 0 and d = 5 then false when s % 4 = 0 and log and f between 10 and 19 then true when log and f = 7 then true when d = 3 or log then false else true end as keep from p)
 select path from q where keep"""


def _layers(spark, sf_dir):
    k = F.col("p_partkey")
    p = _read(spark, sf_dir, "part")
    e = p.select(_c("p{}", k).alias("src"), F.explode(F.array(F.floor(k / 2), F.floor(k / 3), F.when(k % 10 == 7, k - 3), F.when(k % 10 == 4, k + 3))).alias("d")).where("d >= 0").select("src", _c("p{}", "d").alias("dst"))
    return scans.layers(e.join(p.select(_c("p{}", k).alias("dst")), "dst", "left_semi"))


#: Parts that end in 4 and 7 depend on each other: one component, named by its smaller id.
_LAYERS_SQL = """with recursive n as (select p_partkey as k, case when p_partkey % 10 = 7 then p_partkey - 3 else p_partkey end as c from part),
 e as (select distinct a.c as src, b.c as dst from n a join n b on b.k in (a.k // 2, a.k // 3) where a.c <> b.c),
 w as (select distinct c, 0 as layer from n union select src, layer + 1 from w join e on dst = c), m as (select c, max(layer) as layer from w group by c),
 z as (select c, min('p' || k) as component, count(*) as size from n group by c)
 select 'p' || k as id, layer, component from n join m using (c) join z using (c)"""


def _dead(spark, sf_dir):
    k = F.col("p_partkey")
    files = _read(spark, sf_dir, "part").select(_c("m{}.ts", k).alias("path"), _c("export const name{} = name{};\nuse(name{}, name{}); name{}()", k, k * 2, k * 3, k * 3, k).alias("content"))
    return scans.dead_exports(settle(lines(files)))


ALL = {
    "nearest_root": (_nearest, _NEAREST_SQL),
    "workspace_repos": (_workspaces("repos"), _REPOS_SQL),
    "workspace_edges": (_workspaces("edges"), _REPO_SQL + "select 'n' || a.n as workspace, 'repo:c' || a.k as src, 'repo:c' || b.k as dst, cast(0.95 as double) as confidence from r a join r b on a.n = b.n and b.k in (a.k + 5, a.k + 8)"),
    "kept_paths": (_ignored, _IGNORED_SQL),
    "import_layers": (_layers, _LAYERS_SQL),
    "dead_exports": (_dead, "with u as (select j, count(*) as n from (select p_partkey * 2 as j from part where p_partkey > 0 union all select p_partkey * 3 from part where p_partkey > 0) group by j) select 'm' || p_partkey || '.ts' as path, 'name' || p_partkey as name, coalesce(n, 0) as uses from part left join u on j = p_partkey where coalesce(n, 0) < 2"),
    "god_modules": (lambda s, d: scans.god_modules(order_files(s, d)), f"select path, max(end_line) as lines, count(*) as exports, count(*) as functions, 0::bigint as classes, 3 * count(*) as score from ({_SPANS_SQL}) group by path having score >= 15 or lines > 400"),
}
