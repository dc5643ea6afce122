"""All queries of the engine over the driver's tables, and the DuckDB SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.ids import kind_of
from skein.operators import analytics as A
from skein.operators import mining as M
from skein.operators import store as S
from skein.operators import traverse as T
from skein.plans.projection import WITH, graph, occurrences
from skein.schema import FLOW_PRIORITY, RELATIONAL, VIEWS

STRUCT_SQL = "('CALLS','IMPORTS','DEPENDS_ON','CONSUMES','EXPOSES')"
EDGE_ID_SQL = "'e_' || substr(sha256(src || '|' || dst || '|' || type), 1, 12)"


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _starts(nodes, *names):
    return nodes.where(F.col("name").isin(*names) & (F.col("kind") == "Function")).select(F.col("id").alias("source"), "id")


def flagship(spark, sf_dir: str) -> DataFrame:
    n, e = graph(spark, sf_dir)
    return T.impact(n, e, _starts(n, "O0")).select("id", "kind", "name", "depth")


#: Relations of recursive oracles: s(a, b, first) is where a leads; walk(source, id, depth) what is met.
STEPS_SQL = """, s as (
  select src as a, dst as b, false as first from edges where type = 'EXPOSES'
  union all select dst, src, false from edges where type in ('CALLS','CONSUMES','SUBSCRIBES','TESTS')
  union all select src, dst, true from edges where type in ('WRITES','PUBLISHES')
  union all select src, dst, true from edges join nodes on nodes.id = dst where type = 'CALLS' and kind in ('External','API','Event'))"""
UP_SQL = ", s as (select src as a, dst as b, false as first from edges where type in ('CALLS','IMPORTS','READS','CONSUMES','DEPENDS_ON'))"


def _walk(starts: str, depth: int, up: bool = False) -> str:
    stop = "" if up else " and kind not in ('External','Table','Test')"
    return f"""{WITH}{UP_SQL if up else STEPS_SQL}, w as (
  select id as source, id, 0 as depth from nodes where {starts}
  union select source, b, depth + 1 from w join nodes using (id) join s on a = id where depth < {depth}{stop} and (depth = 0 or not first)),
  met as (select source, id, min(depth) as depth from w group by source, id) """


_START = "kind = 'Function' and name = 'O0'"
_MANY = "kind = 'Function' and name in ('O0','O1','O2','O3','O4','O5','O6','O7')"
_MANY_NAMES = [f"O{i}" for i in range(8)]


def _impact(direction="downstream", depth=5, *names):
    def run(spark, sf_dir):
        n, e = graph(spark, sf_dir)
        return T.impact(n, e, _starts(n, *(names or ("O0",))), direction, depth).select("source", "id", "kind", "name", "depth")

    return run


def _graph(f):
    return lambda spark, sf_dir: f(*graph(spark, sf_dir))


def _risks(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    return T.impact_risks(n, e, T.reach(n, e, _starts(n, *_MANY_NAMES), max_depth=3))


def _severity(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    met = T.reach(n, e, _starts(n, *_MANY_NAMES), max_depth=3)
    return T.severity(T.reported(n, met), T.impact_risks(n, e, met))


_RISKS_SQL = """, reported as (select source, met.id, depth, kind, critical from met join nodes using (id)),
  live as (select * from reported where kind not in ('External','Table','Test')),
  hop as (select distinct l.source, l.id as at, l.depth, e.type, case when e.src = l.id then e.dst else e.src end as to_id from live l join edges e on
    (e.src = l.id and (e.type = 'EXPOSES' or (l.depth = 0 and (e.type in ('WRITES','PUBLISHES') or (e.type = 'CALLS' and e.dst in (select id from nodes where kind in ('External','API','Event')))))))
    or (e.dst = l.id and e.type in ('CALLS','CONSUMES','SUBSCRIBES','TESTS'))),
  chip as (select hop.* from hop left join met on met.source = hop.source and met.id = to_id where met.depth is null or met.depth > hop.depth),
  risks as (
    select source, 'critical' as kind, id as node_id from reported where critical
    union select source, 'db_write', to_id from chip where type = 'WRITES'
    union select chip.source, 'external', to_id from chip join nodes on nodes.id = to_id where kind = 'External'
    union select source, 'untested', id from reported where depth = 0 and kind in ('Function','Method') and id not in (select dst from edges where type = 'TESTS')) """


def _affected(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    return T.impact(n, e, _starts(n, "O0")).groupBy("kind").agg(F.count(F.when(F.col("depth") > 0, 1)).alias("items"), F.count("*").alias("n"))


#: Customers of one country: some have tests, and their orders' other customers have some, too.
_TESTED = "kind = 'Function' and path = 'customer/N3'"


def _tests_to_run(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    starts = n.where(_TESTED).select(F.col("id").alias("source"), "id")
    return T.impact(n, e, starts, "downstream", 3, kind="Test").select("source", "id")


def _impact_edges(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    return T.impact_edges(n, e, T.reach(n, e, _starts(n, "O0"), max_depth=2)).select(F.col("edge_id").alias("id"), "type", "to", "depth")


def _flow(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    start = n.where("kind = 'Service'").orderBy("id").first()["id"]
    return T.flow(n, e, start)


_FLOW_RANK = " ".join(f"when '{t}' then {i}" for i, t in enumerate(FLOW_PRIORITY))
_FLOW_SQL = f"""{WITH}, h as (select src, dst, type from (select *, row_number() over (partition by src order by case type {_FLOW_RANK} end, {EDGE_ID_SQL}) as r
   from edges where type in {FLOW_PRIORITY}) where r = 1),
 f as (select 1 as step_no, min(id) as node_id, [min(id)] as been from nodes where kind = 'Service'
   union all select step_no + 1, dst, list_append(been, dst) from f join h on src = node_id where step_no < 10 and not list_contains(been, dst))
 select step_no, node_id, kind || ': ' || name as label, type as edge_type from f join nodes on id = node_id left join h on src = node_id"""


def _why(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    a = n.where("kind = 'Function' and name = 'O0'").first()["id"]
    b = e.where((F.col("src") == a) & (F.col("type") == "WRITES")).orderBy("dst").first()["dst"]
    return T.why_paths(n, e, a, b, max_depth=3, max_paths=None).groupBy("length").agg(F.count("*").alias("n"))


_WHY_SQL = f"""{WITH}, r as (select {EDGE_ID_SQL} as eid, src, dst from edges where type in {RELATIONAL}),
 ends as (select (select id from nodes where {_START}) as a, (select min(dst) from edges where type = 'WRITES' and src = (select id from nodes where {_START})) as b),
 k as (select src as x, dst as y, eid from r union all select dst, src, eid from r where src <> dst),
 p1 as (select y as pos, [eid] as used from k, ends where x = a),
 p2 as (select y as pos, list_append(used, eid) as used from p1, k, ends where x = pos and pos <> b and not list_contains(used, eid)),
 p3 as (select y as pos, list_append(used, eid) as used from p2, k, ends where x = pos and pos <> b and not list_contains(used, eid) and (y <> a or true)),
 f1 as (select distinct pos from p1)
 select 1 as length, count(*) as n from p1, ends where pos = b having count(*) > 0
 union all select 2, count(*) from p2, ends where pos = b having count(*) > 0
 union all select 3, count(*) from p3, ends where pos = b having count(*) > 0"""


def _clusters(n, e):
    return A.clusters(n, e)[1].select("a", "b", "n")


def _view(mode):
    return _graph(lambda n, e: A.view(n, e, mode, None)[0].select("id", "kind", "name"))


def _view_edges(n, e):
    return A.view(n, e, "api", None)[1].select("type", "src", "dst")


def _kinds(mode):
    return "(" + ",".join(f"'{k}'" for k in VIEWS[mode][0]) + ")"


def _commits(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file"))


def _coverage(spark, sf_dir):
    spans = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("f").alias("file"), F.col("p_size").alias("start_line"), (F.col("p_size") + 9).alias("end_line"))
    hits = _read(spark, sf_dir, "events").select(F.lit("f").alias("file"), F.floor("value").cast("int").alias("line"), F.lit(1).alias("hits")).where("line is not null")
    return M.coverage(spans, hits)


_RULES = [(1, "https://*/", ["@web"]), (2, "https://**/page/**", ["@pages"]), (3, "http", ["@all"]), (4, "https://site1", ["@one"]), (5, "**0", ["@zero", "@all"])]


def _owners(spark, sf_dir):
    rules = spark.createDataFrame(_RULES, "line int, pattern string, owners array<string>")
    files = _read(spark, sf_dir, "pages").select(F.col("url").alias("path")).where("path is not null").distinct()
    return M.code_owners(rules, files).select("path", F.array_join("owners", ",").alias("owners"))


_OWNERS_SQL = """with f as (select distinct url as path from pages where url is not null),
 m as (select path, 1 as line, '@web' as o from f where starts_with(path, 'https://*') union all
   select path, 2, '@pages' from f where regexp_matches(path, '^https://.*/page/.*$') union all select path, 3, '@all' from f where starts_with(path, 'http')
   union all select path, 4, '@one' from f where starts_with(path, 'https://site1') union all select path, 5, '@zero' from f where regexp_matches(path, '^.*0$') union all select path, 6, '@all' from f where regexp_matches(path, '^.*0$')),
 d as (select path, o, min(line) as line from m group by path, o)
 select path, string_agg(o, ',' order by line) as owners from d group by path"""

_QUERY = "the that of the license queue"
_TOKENS_SQL = "list_filter(string_split_regex(regexp_replace(lower({}), '[^a-z0-9_.:/\\-]', ' ', 'g'), '\\s+'), lambda t: length(t) > 1)"


def _search(spark, sf_dir):
    chunks = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("content"))
    return M.search(chunks, _QUERY, None).select("chunk_id", "score")


_SEARCH_SQL = f"""with q as (select unnest({_TOKENS_SQL.format("'" + _QUERY + "'")}) as token),
 t as (select doc_id as chunk_id, unnest(list_distinct({_TOKENS_SQL.format("coalesce(text, '')")})) as token from documents)
 select chunk_id, count(*) / (select count(*) from q)::double as score from t join q using (token) group by chunk_id"""


def _docs(spark, sf_dir):
    n, _ = graph(spark, sf_dir)
    return M.score_docs(n.where("kind = 'Doc'"), "docs of source src1 and d1", "docs/src1", None).select("id", F.col("score").cast("long").alias("score"))


def _parts(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    old = p.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("signature"), F.col("p_retailprice").cast("string").alias("body"))
    k = F.col("p_partkey") % 10
    new = p.where(k != 0).select(F.col("p_partkey").alias("k"), F.when(k == 1, F.concat("p_brand", F.lit("x"))).otherwise(F.col("p_brand")).alias("signature"), F.when(k == 2, "y").otherwise(F.col("p_retailprice").cast("string")).alias("body"))
    new = new.unionByName(p.where(k == 5).select((F.col("p_partkey") + 10_000_000).alias("k"), F.col("p_brand").alias("signature"), F.lit("z").alias("body")))
    fix = lambda d: d.select(F.concat(F.lit("table:P"), F.col("k").cast("string")).alias("id"), "signature", "body")
    return fix(old), fix(new)


_DIFF_SQL = """select 'table:P' || p_partkey as id, case p_partkey % 10 when 0 then 'removed' when 1 then 'signature_changed' when 2 then 'body_only' end as change,
  trim(p_brand) as old_signature, case p_partkey % 10 when 0 then null when 1 then p_brand || 'x' else p_brand end as new_signature from part where p_partkey % 10 in (0, 1, 2)
 union all select 'table:P' || (p_partkey + 10000000), 'added', null, p_brand from part where p_partkey % 10 = 5"""


def _manifest_diff(spark, sf_dir):
    old, new = _parts(spark, sf_dir)
    fix = lambda d: M.manifest(d.select(F.col("id").alias("path"), F.concat("signature", "body").alias("content")))
    return M.manifest_diff(fix(old), fix(new))


def _edge_fold(spark, sf_dir):
    f = S.fold_edges(occurrences(spark, sf_dir))
    line = F.transform("evidence", lambda x: F.concat_ws(":", x["line"].cast("string"), x["snippet"]))
    return f.select("id", "type", "src", "dst", F.array_join(line, ",").alias("evidence"), F.array_join("sources", ",").alias("sources"), "confidence", "conflict")


_FOLD_SQL = """with o as (select 'table:P' || (l_partkey % 50) as dst, l_linenumber as line, l_returnflag as flag, l_quantity / 100 as confidence, l_orderkey % 97 = 0 as conflict, l_orderkey as k1, l_linenumber as k2, l_quantity as k3
   from lineitem join orders on l_orderkey = o_orderkey),
 n as (select *, row_number() over (partition by dst order by k1, k2, flag, k3) as n from o),
 k as (select dst, coalesce(max(case when conflict and n > 1 then n end), 1) as k, bool_or(conflict) as any_conflict from n group by dst),
 l as (select n.*, any_conflict from n join k using (dst) where n.n >= k.k),
 e as (select dst, line, arg_min(flag, n) as flag, min(n) as n from l group by dst, line),
 s as (select dst, 's' || flag as s, min(n) as n from l group by dst, flag)
 select 'e_' || substr(sha256('table:L|' || dst || '|WRITES'), 1, 12) as id, 'WRITES' as type, 'table:L' as src, dst,
  (select string_agg(line || ':' || flag, ',' order by n) from e where e.dst = g.dst) as evidence,
  (select string_agg(s, ',' order by n) from s where s.dst = g.dst) as sources, max(confidence) as confidence, bool_or(any_conflict) as conflict from l g group by dst"""


def _node_fold(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select(F.concat(F.lit("event:"), F.col("user_id").cast("string")).alias("id"), F.col("event_type").alias("name"), "value", F.col("event_id").alias("seq"))
    return S.fold_nodes(e).select("id", "name", "value")


def _journal(spark, sf_dir):
    j = _read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("event"))
    return M.journal_tail(j, 25, "click")


def _streaks(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    kinds = e.agg(F.min("event_type").alias("k"))
    p = e.crossJoin(F.broadcast(kinds)).select((F.col("user_id") % 5).alias("repo"), F.col("event_id").alias("seq"), (F.col("event_type") == F.col("k")).alias("is_conflict"))
    return M.conflict_streaks(p)


def _debate(spark, sf_dir):
    n, _ = graph(spark, sf_dir)
    b = _read(spark, sf_dir, "orders")
    p = b.select(F.col("o_orderkey").cast("string").alias("id"), F.lit("plan").alias("title"), F.concat(F.lit("change table:P"), F.col("o_orderkey").cast("string"), F.lit(" and fn:orders/"), "o_orderstatus", F.lit(":O"), F.col("o_orderkey").cast("string"), F.lit(" not svc:none")).alias("body"))
    return A.debate(p, n).select("id", "present", "missing", "score")


_PATHS = "case p_partkey % 4 when 0 then 'apps/' || lower(substr(p_brand, 1, 8)) || '/a' || p_partkey || '.ts' when 1 then 'packages/' || p_size || '/b.ts' when 2 then 'src/' || p_size || '/c.ts' else 'lib/d.ts' end"


def _identify(spark, sf_dir):
    files = _read(spark, sf_dir, "part").select(F.expr(_PATHS).alias("path"))
    return A.identify_services(files)


def _definitions(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("s"), (F.col("p_partkey") % 1700).cast("string")).alias("symbol"), F.concat(F.lit("src/f"), (F.col("p_partkey") % 90).cast("string"), F.lit(".ts")).alias("path"), F.concat(F.lit("fn:"), F.col("p_partkey").cast("string")).alias("id"))


def _calls(spark, sf_dir):
    line = _read(spark, sf_dir, "lineitem")
    calls = line.select(F.concat(F.lit("fn:o"), F.col("l_orderkey").cast("string")).alias("caller"), F.concat(F.lit("src/f"), (F.col("l_suppkey") % 90).cast("string"), F.lit(".ts")).alias("path"), F.concat(F.lit("s"), (F.col("l_partkey") % 1800).cast("string")).alias("name")).distinct()
    imports = _read(spark, sf_dir, "supplier").select(F.concat(F.lit("src/f"), (F.col("s_suppkey") % 90).cast("string"), F.lit(".ts")).alias("path"), F.concat(F.lit("src/f"), ((F.col("s_suppkey") + 7) % 90).cast("string"), F.lit(".ts")).alias("file")).distinct()
    return M.resolve_calls(calls, _definitions(spark, sf_dir), imports)


_CALLS_SQL = """with d as (select 's' || (p_partkey % 1700) as name, 'src/f' || (p_partkey % 90) || '.ts' as path, 'fn:' || p_partkey as id from part),
 c as (select distinct 'fn:o' || l_orderkey as caller, 'src/f' || (l_suppkey % 90) || '.ts' as path, 's' || (l_partkey % 1800) as name from lineitem),
 i as (select distinct 'src/f' || (s_suppkey % 90) || '.ts' as path, 'src/f' || ((s_suppkey + 7) % 90) || '.ts' as file from supplier),
 l as (select path, name, max(id) as l from d group by all), m as (select i.path, d.name, max(d.id) as i from i join d on d.path = i.file group by all),
 g as (select name, max(id) as g from d group by name having count(distinct path) = 1)
 select caller, name, coalesce(l, i, g) as callee, cast(case when l is not null then 1.0 when i is not null then 0.95 else 0.75 end as double) as confidence
 from c left join l using (path, name) left join m using (path, name) left join g using (name) where coalesce(l, i, g) is not null"""


def _imports(spark, sf_dir):
    files = _read(spark, sf_dir, "supplier").select(F.concat(F.lit("src/m"), F.floor(F.col("s_suppkey") / 2).cast("string"), F.when(F.col("s_suppkey") % 2 == 0, "/index.ts").otherwise(".js")).alias("path"), F.col("s_suppkey").alias("seq"))
    imports = _read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.concat(F.lit("src/m"), (F.col("c_custkey") % 80).cast("string")).alias("target"))
    return M.resolve_imports(imports, files)


def _degree(n, e):
    return A.degrees(e).select("id", F.col("n_in").cast("long").alias("n_in"), F.col("n_out").cast("long").alias("n_out"), F.col("total").cast("long").alias("total"))


_DEG_SQL = f""", deg as (select id, cast(sum(i) as bigint) as n_in, cast(sum(o) as bigint) as n_out, cast(sum(i + o) as bigint) as total
  from (select src as id, 0 as i, 1 as o from edges where type in {STRUCT_SQL} union all select dst, 1, 0 from edges where type in {STRUCT_SQL}) group by id),
 sc as (select nodes.id, kind, name, coalesce(n_in, 0) as n_in, coalesce(n_out, 0) as n_out, coalesce(total, 0) as total from nodes left join deg on deg.id = nodes.id
  where kind not in ('File','Repo','Doc','External','Interface','Column','ConfigKey') and (coalesce(total, 0) > 0 or kind in ('Function','Method','Class','Module'))) """
_DOWN_SQL = _walk("id in (select id from topc)", 4).replace(STEPS_SQL, _DEG_SQL + ", topc as (select * from sc where total > 0 order by total desc, name, id limit 20)" + STEPS_SQL) + ", dn as (select source as id, count(*) - 1 as downstream from met join nodes using (id) group by source), dd as (select topc.id, topc.kind, topc.name, topc.total, downstream from topc join dn using (id)) "

_ALL = {
    "impact_downstream": (_impact(), _walk(_START, 5) + "select source, id, kind, name, depth from met join nodes using (id)"),
    "impact_upstream": (_impact("upstream", 4), _walk(_START, 4, True) + "select source, id, kind, name, depth from met join nodes using (id)"),
    "impact_depth_zero": (_impact("downstream", 0), _walk(_START, 0) + "select source, id, kind, name, depth from met join nodes using (id)"),
    "multi_source_impact": (_impact("downstream", 3, *_MANY_NAMES), _walk(_MANY, 3) + "select source, id, kind, name, depth from met join nodes using (id)"),
    "impact_counts": (_affected, _walk(_START, 5) + "select kind, count(case when depth > 0 then 1 end) as items, count(*) as n from met join nodes using (id) group by kind"),
    "impact_tests": (_tests_to_run, _walk(_TESTED, 3) + "select source, id from met join nodes using (id) where kind = 'Test'"),
    "impact_edges": (_impact_edges, _walk(_START, 2) + _RISKS_SQL + f""", ie as (select distinct {EDGE_ID_SQL} as id, e.type, case when e.src = l.id then e.dst else e.src end as to_id, l.depth from live l join edges e on
      (e.src = l.id and (e.type = 'EXPOSES' or (l.depth = 0 and (e.type in ('WRITES','PUBLISHES') or (e.type = 'CALLS' and e.dst in (select id from nodes where kind in ('External','API','Event')))))))
      or (e.dst = l.id and e.type in ('CALLS','CONSUMES','SUBSCRIBES','TESTS'))) select id, type, to_id as "to", depth from ie"""),
    "impact_risks": (_risks, _walk(_MANY, 3) + _RISKS_SQL + "select * from risks"),
    "impact_severity": (_severity, _walk(_MANY, 3) + _RISKS_SQL + """select r.source, count(case when depth > 0 and r.kind <> 'File' then 1 end) as affected,
      case when coalesce(bool_or(bad), false) or count(case when depth > 0 and r.kind <> 'File' then 1 end) > 10 then 'critical' when coalesce(bool_or(some_), false) or count(case when depth > 0 and r.kind <> 'File' then 1 end) > 3 then 'medium' else 'low' end as severity
      from reported r left join (select source, bool_or(kind in ('critical','conflict')) as bad, bool_or(kind in ('untested','db_write','external')) as some_ from risks group by source) k on k.source = r.source group by r.source"""),
    "graph_nodes_by_kind": (_graph(lambda n, e: n.groupBy("kind").agg(F.count("*").alias("n"))), WITH + "select kind, count(*) as n from nodes group by kind"),
    "graph_edges_by_type": (_graph(lambda n, e: e.groupBy("type").agg(F.count("*").alias("n"))), WITH + "select type, count(*) as n from edges group by type"),
    "edge_ids": (_graph(lambda n, e: e.where("type in ('WRITES', 'TESTS')").select("id", "src", "dst")), WITH + f"select {EDGE_ID_SQL} as id, src, dst from edges where type in ('WRITES', 'TESTS')"),
    "kind_by_prefix": (_graph(lambda n, e: n.groupBy(kind_of(F.col("id")).alias("kind"), F.col("kind").alias("stored")).agg(F.count("*").alias("n"))), WITH + "select kind, kind as stored, count(*) as n from nodes group by kind"),
    "list_nodes_page": (_graph(lambda n, e: S.page(n, "Function", limit=100, offset=50).select("id", "name")), WITH + "select id, name from nodes where kind = 'Function' order by name, id limit 100 offset 50"),
    "search_nodes_like": (_graph(lambda n, e: S.search_like(n, "ORDERS/F:o1_", None).select("id", "name")), WITH + "select id, name from nodes where name ilike '%ORDERS/F:o1_%' or path ilike '%ORDERS/F:o1_%' or id ilike '%ORDERS/F:o1_%'"),
    "resolve_node": (_graph(lambda n, e: S.resolve(n, "O12").select("id", "kind", "name")), WITH + ", h as (select *, 1 as x from nodes where name ilike '%O12%' or path ilike '%O12%' or id ilike '%O12%' order by name, id limit 10) select id, kind, name from (select id, kind, name, 0 as r from nodes where id = 'O12' union all select id, kind, name, case when name = 'O12' then 1 when id like '%:O12' or id like '%/O12' then 2 else 3 end from h) order by r, name, id limit 1"),
    "neighbors_both": (_graph(lambda n, e: S.neighbours(e, "svc:N3").select("type", "src", "dst")), WITH + "select type, src, dst from edges where src = 'svc:N3' union all select type, src, dst from edges where dst = 'svc:N3'"),
    "where_used": (_graph(lambda n, e: S.where_used(n, e, "table:P7")), WITH + "select src, type, kind, name from edges left join nodes on id = src where dst = 'table:P7'"),
    "depends_on": (_graph(lambda n, e: S.depends_on(n, e, "svc:N3")), WITH + "select dst, type, kind, name from edges left join nodes on id = dst where src = 'svc:N3'"),
    "validate_dangling": (_graph(lambda n, e: S.dangling(n.where("kind <> 'Event'"), e).select("type", "src", "dst")), WITH + "select type, src, dst from edges where src not in (select id from nodes where kind <> 'Event') or dst not in (select id from nodes where kind <> 'Event')"),
    "validate_graph": (_graph(lambda n, e: S.validate(n, e.unionByName(e.where("type = 'DEPENDS_ON'").withColumn("dst", F.col("src")))).groupBy("problem").agg(F.count("*").alias("n"))), WITH + "select 'self_loop' as problem, count(*) as n from edges where type = 'DEPENDS_ON'"),
    "orphans": (_graph(lambda n, e: A.orphans(n, e).select("id", "kind")), WITH + "select id, kind from nodes where id not in (select src from edges) and id not in (select dst from edges)"),
    "degree": (_graph(_degree), WITH + _DEG_SQL + "select * from deg"),
    "highly_coupled": (_graph(lambda n, e: A.highly_coupled(A.scored(n, e))), WITH + _DEG_SQL + "select id, kind, name, total as score from sc where total >= 4 order by total desc, name, id limit 8"),
    "bottlenecks": (_graph(lambda n, e: A.bottlenecks(A.scored(n, e))), WITH + _DEG_SQL + "select id, kind, name, cast(n_in * n_out as bigint) as score from sc where n_in >= 2 and n_out >= 2 order by score desc, name, id limit 8"),
    "hubs": (_graph(lambda n, e: A.hubs(A.scored(n, e))), WITH + _DEG_SQL + "select id, kind, name, total as score from sc order by total desc, name, id limit 8"),
    "isolated": (_graph(lambda n, e: A.isolated(A.scored(n, e), None)), WITH + _DEG_SQL + "select id, kind, name, total as score from sc where total = 0 and kind in ('Function','Method','Class','Module')"),
    "most_connected": (_graph(A.most_connected), WITH + "select id, kind, name, cast(count(*) as bigint) as score from (select src as id from edges union all select dst from edges) join nodes using (id) group by id, kind, name order by score desc, name, id limit 5"),
    "large_downstream": (_graph(lambda n, e: A.large_downstream(A.downstream_of_top(n, e))), _DOWN_SQL + "select id, kind, name, downstream as score from dd where downstream >= 3 order by score desc, name, id limit 8"),
    "hotspots": (_graph(lambda n, e: A.hotspots(A.downstream_of_top(n, e))), _DOWN_SQL + "select id, kind, name, cast(downstream + total as bigint) as score from dd where downstream >= 5 or (total >= 6 and downstream >= 2) order by score desc, name, id limit 8"),
    "flow_walk": (_flow, _FLOW_SQL),
    "why_path_lengths": (_why, _WHY_SQL),
    "depth_view_nodes": (_graph(lambda n, e: T.depth_view(n, e, "table:P7", 2)), WITH + ", b as (select src as a, dst as b from edges union all select dst, src from edges), v as (select 'table:P7' as id, 0 as depth union select b, depth + 1 from v join b on a = id where depth < 2) select id, min(depth) as depth from v group by id"),
    "cluster_projection": (_graph(_clusters), WITH + ", o as (select id, coalesce(path, '(' || kind || ')') as c from nodes) select x.c as a, y.c as b, count(*) as n from edges join o x on x.id = src join o y on y.id = dst where type <> 'CONTAINS' and x.c <> y.c group by all"),
    "view_api_edges": (_graph(_view_edges), WITH + f"select type, src, dst from edges where type in ('EXPOSES','CONSUMES','DEPENDS_ON') and src in (select id from nodes where kind in {_kinds('api')}) and dst in (select id from nodes where kind in {_kinds('api')})"),
    "co_change": (lambda s, d: M.co_change(_commits(s, d)), "with f as (select distinct l_orderkey as c, l_partkey as f from lineitem), k as (select c from f group by c having count(*) between 2 and 15), g as (select * from f join k using (c)) select x.f as a, y.f as b, count(*) as n, least(1.0::double, count(*) / 10.0::double) as confidence from g x join g y using (c) where x.f < y.f group by all having count(*) >= 3"),
    "file_churn": (lambda s, d: M.churn(_commits(s, d)), "select l_partkey as file, count(*) as n from lineitem group by 1"),
    "coverage_ranges": (_coverage, "with h as (select distinct cast(floor(value) as integer) as line from events where value is not null) select p_partkey as id, count(line) as covered, cast(10 as bigint) as total, cast(floor(100.0 * count(line) / 10 + 0.5) as bigint) as pct from part left join h on line between p_size and p_size + 9 group by p_partkey"),
    "code_owner_match": (_owners, _OWNERS_SQL),
    "lexical_search": (_search, _SEARCH_SQL),
    "docs_scoring": (_docs, WITH + ", p as (select unnest(['docs','source','src1','and']) as p) select id, cast(s as bigint) as score from (select id, (select count(*) from p where contains(lower(name || ' ' || coalesce(path, '') || ' ' || id), p)) + case when regexp_replace(path, '/?[^/]*$', '') = 'docs' then 2 else 0 end + case when contains(lower(path), 'readme') then 1 else 0 end + case when contains(lower(path), 'adr') then 1 else 0 end as s from nodes where kind = 'Doc') where s > 0"),
    "edge_fold": (_edge_fold, _FOLD_SQL),
    "node_fold": (_node_fold, "select 'event:' || user_id as id, arg_max(event_type, event_id) as name, arg_max(value, event_id) as value from events group by user_id"),
    "symbol_diff": (lambda s, d: M.symbol_diff(*_parts(s, d)), _DIFF_SQL),
    "manifest_diff": (_manifest_diff, "select 'table:P' || p_partkey as path, case p_partkey % 10 when 0 then 'removed' else 'changed' end as change from part where p_partkey % 10 in (0, 1, 2) union all select 'table:P' || (p_partkey + 10000000), 'added' from part where p_partkey % 10 = 5"),
    "policy_violations": (_graph(A.policies), WITH + "select 'critical-must-have-tests' as policy, id as node_id from nodes where critical and id not in (select dst from edges where type = 'TESTS')"),
    "health": (_graph(A.health), WITH + """select 'graph' as category, 'nodes' as item, count(*) as n from nodes union all select 'graph', 'edges', count(*) from edges union all select 'validation', 'errors', (select count(*) from edges where src not in (select id from nodes) or dst not in (select id from nodes))
      union all select 'edges', type, count(*) from edges where type in ('CONTAINS','IMPORTS','CALLS','EXPOSES','CONSUMES','READS','WRITES','TESTS','DEPENDS_ON','DOCUMENTS','CO_CHANGED') group by type
      union all select 'orphans', 'nodes', count(*) from nodes where id not in (select src from edges) and id not in (select dst from edges)
      union all select 'coverage', kind, count(*) from nodes where kind in ('Service','Function','API','Table','Test','External','Class') group by kind"""),
    "verify_graph": (_graph(A.verify), WITH + "select 'not_empty' as name, count(*) > 0 as passed, count(*) || ' nodes' as message from nodes union all select 'no_dangling', (select count(*) from edges where src not in (select id from nodes) or dst not in (select id from nodes)) = 0, (select count(*) from edges where src not in (select id from nodes) or dst not in (select id from nodes)) || ' dangling edges'"),
    "explain_node": (_graph(lambda n, e: A.explain_node(e, "table:P7").union(A.explain_node(e, "svc:N3"))), WITH + ", t as (select unnest(['table:P7','svc:N3']) as id) select count(case when type='CALLS' and dst=id then 1 end) as callers, count(case when type='CALLS' and src=id then 1 end) as callees, count(case when type='READS' and src=id then 1 end) as reads, count(case when type='WRITES' and src=id then 1 end) as writes, count(case when type='EXPOSES' and src=id then 1 end) as apis, count(case when type='TESTS' and dst=id then 1 end) as tests from t join edges on src = id or dst = id group by id"),
    "plan_files": (lambda s, d: A.plan_files(_impact_full(s, d)), _walk(_MANY, 3) + "select distinct path from met join nodes using (id) where path is not null and (depth = 0 or kind in ('Function','Method','Class','File','Test'))"),
    "identify_services": (_identify, f"with f as (select {_PATHS} as path from part), m as (select regexp_extract(path, '^(apps|services|packages|src)/([^/]+)/', 1) as a, regexp_extract(path, '^(apps|services|packages|src)/([^/]+)/', 2) as name from f where regexp_matches(path, '^(apps|services|packages|src)/([^/]+)/')) select 'svc:' || name as service_id, name, a || '/' || name as bucket, count(*) as files from m group by a, name"),
    "import_resolution": (_imports, "with f as (select 'src/m' || (s_suppkey // 2) as k, s_suppkey as seq, 'src/m' || (s_suppkey // 2) || case when s_suppkey % 2 = 0 then '/index.ts' else '.js' end as path from supplier), g as (select k, arg_min(path, seq) as file from f group by k) select cast(c_custkey as varchar) as path, 'src/m' || (c_custkey % 80) as target, file from customer left join g on k = 'src/m' || (c_custkey % 80)"),
    "call_resolution": (_calls, _CALLS_SQL),
    "symbol_uniqueness": (lambda s, d: M.unique_symbols(_definitions(s, d)), "select 's' || (p_partkey % 1700) as symbol, max('fn:' || p_partkey) as id from part group by p_partkey % 1700 having count(distinct p_partkey % 90) = 1"),
    "journal_recent": (_journal, "select * from (select event_id as seq, event_type as event from events order by event_id desc limit 1000) where event = 'click' order by seq desc limit 25"),
    "circuit_streaks": (_streaks, "with e as (select user_id % 5 as repo, event_id as seq, event_type = (select min(event_type) from events) as c from events), g as (select *, sum(case when c then 0 else 1 end) over (partition by repo order by seq) as g from e) select repo, seq, cast(sum(c::int) over (partition by repo, g order by seq) as bigint) as streak from g"),
    "debate_scores": (_debate, WITH + "select cast(o_orderkey as varchar) as id, cast(1 + case when o_orderkey in (select p_partkey from part) then 1 else 0 end as bigint) as present, cast(1 + case when o_orderkey in (select p_partkey from part) then 0 else 1 end as bigint) as missing, cast(1 + case when o_orderkey in (select p_partkey from part) then 1 else 0 end - 2 * (1 + case when o_orderkey in (select p_partkey from part) then 0 else 1 end) as bigint) as score from orders"),
}
for _m in ("height", "call", "db"):
    _ALL[f"view_{_m}"] = (_view(_m), WITH + f"select id, kind, name from nodes where kind in {_kinds(_m)}")


def _impact_full(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    return T.impact(n, e, _starts(n, *_MANY_NAMES), "downstream", 3)


def _every() -> dict:
    from skein.plans import more, scan_plans, source_plans

    return _ALL | more.ALL | source_plans.ALL | scan_plans.ALL


def queries() -> dict:
    return {k: q for k, (q, _) in _every().items()}


def oracle_sql() -> dict:
    return {k: s for k, (_, s) in _every().items() if s}
