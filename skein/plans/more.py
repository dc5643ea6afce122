"""Queries of chains, changes, pickers, versions and snapshots over the driver's tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skein.operators import analytics as A
from skein.operators import changes as C
from skein.operators import paths as P
from skein.operators import snapshot as N
from skein.operators import traverse as T
from skein.operators.loops import shared_dir
from skein.plans.catalog import _DOWN_SQL, _MANY, _MANY_NAMES, _RISKS_SQL, _START, EDGE_ID_SQL, _graph, _kinds, _read, _starts, _walk
from skein.plans.projection import WITH, graph
from skein.schema import VIEWS

#: Steps with the edge's id; all chains from the starts, and the first of the shortest ones to each id.
_CHAINS_SQL = f""", ee as (select *, {EDGE_ID_SQL} as eid from edges), s as (
  select src as a, dst as b, false as first, eid from ee where type = 'EXPOSES'
  union all select dst, src, false, eid from ee where type in ('CALLS','CONSUMES','SUBSCRIBES','TESTS')
  union all select src, dst, true, eid from ee where type in ('WRITES','PUBLISHES')
  union all select src, dst, true, eid from ee join nodes on nodes.id = dst where type = 'CALLS' and kind in ('External','API','Event'))"""


def _chains(starts: str, depth: int) -> str:
    return f"""{WITH}{_CHAINS_SQL}, w as (
  select id as source, id, 0 as depth, cast([] as varchar[]) as chain from nodes where {starts}
  union all select source, b, depth + 1, list_append(chain, eid) from w join nodes using (id) join s on a = id
    where depth < {depth} and kind not in ('External','Table','Test') and (depth = 0 or not first)),
  f as (select * from (select *, row_number() over (partition by source, id order by depth, chain) as r from w) where r = 1 and depth > 0) """


def _text(df):
    return df.select("source", "id", "depth", F.array_join("path", ",").alias("path"))


def _impact_paths(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    return _text(P.impact_paths(n, e, _starts(n, *_MANY_NAMES), max_depth=3, max_paths=None))


def _shortest(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    start = n.where("id = 'svc:N3'").select(F.col("id").alias("source"), "id")
    return _text(P.shortest_paths(e, start, n.where("kind in ('Repo', 'API')")))


def _single(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    met = T.reach(n, e, _starts(n, *_MANY_NAMES), max_depth=2)
    none = spark.createDataFrame([], "source string, id string, depth int, path array<string>")
    return _text(P.single_steps(n, e, met, none)).select("source", "path")


_DEBT = "c_acctbal < -500"


def _sides(spark, sf_dir):
    """Symbols of customers before and after a change of those in debt, and the paths of these."""
    c = _read(spark, sf_dir, "customer")
    id_ = F.concat(F.lit("fn:customer/N"), F.col("c_nationkey").cast("string"), F.lit(":C"), F.col("c_custkey").cast("string"))
    old = c.select(id_.alias("id"), F.col("c_mktsegment").alias("signature"), F.col("c_name").alias("body"))
    new = c.select(id_.alias("id"), F.when(F.expr(_DEBT), F.lit("changed")).otherwise(F.col("c_mktsegment")).alias("signature"), F.col("c_name").alias("body"))
    return old, new, c.where(_DEBT).select(F.concat(F.lit("customer/N"), F.col("c_nationkey").cast("string")).alias("path")).distinct()


def _diff(part, same=False):
    def run(spark, sf_dir):
        n, e = graph(spark, sf_dir)
        old, new, paths = _sides(spark, sf_dir)
        found = C.diff_impact(n, e, old, old if same else new, paths, max_depth=2)[part]
        return found.select("id", "change") if part == "symbols" else found.select("id", "kind", "depth")

    return run


_DEBTORS = f"(select 'fn:customer/N' || c_nationkey || ':C' || c_custkey from customer where {_DEBT})"


def _conflicts(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    return T.impact_risks(n, e, T.reach(n, e, _starts(n, *_MANY_NAMES), max_depth=3), e.where("type = 'WRITES'")).where("kind = 'conflict'")


def _api_policy(n, e):
    """Services expose what they consume; the graph has contracts for some paths."""
    api = e.where("type = 'CONSUMES'").select("id", F.lit("EXPOSES").alias("type"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    contract = n.where("kind = 'API' and name < 'f'").select(F.concat(F.lit("contract:"), "id").alias("id"), F.lit("Contract").alias("kind"), "name", "path", "tags")
    return A.policies(n.unionByName(contract), e.unionByName(api)).where("policy = 'public-api-requires-contract'")


def _verify_work(n, e):
    claims = n.sparkSession.createDataFrame([("table:P7",), ("O12",), ("nowhere",)], "claim string")
    touched = n.where("kind = 'Function' and path like 'orders/%'").select("path").distinct()
    with_conflicts = e.withColumn("conflict", F.col("type") == "PUBLISHES")
    return C.verify_work(n, with_conflicts, claims, touched.where("path <> 'orders/F'"), touched).select("name", "passed")


def _budgets(spark, sf_dir):
    t = _read(spark, sf_dir, "conversations")
    calls = t.groupBy(F.col("conv_id").alias("run"), F.col("turn").alias("seq")).agg(F.sum(F.coalesce(F.char_length("text"), F.lit(0))).alias("input"), F.lit(10).cast("long").alias("output"), F.lit(1.0).alias("seconds"))
    return C.budgets(calls, max_calls=6, max_input=500)


def _replaced(spark, sf_dir):
    """A stored graph after a replacement, a transaction on it, and one whose work fails, which changes nothing: sizes in all
    (of is null) and by kind or type, with the version."""
    n, e = graph(spark, sf_dir)
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    N.replace(path, n, e)
    N.transaction(spark, path, lambda g: (g[0].where("kind <> 'Doc'"), g[1].where("type <> 'CONTAINS'")))
    try:
        N.transaction(spark, path, lambda g: (g[0].limit(0), g[1].select(F.raise_error(F.lit("no")).alias("x"))))
    except Exception:  # noqa: BLE001  the failure is the point: nothing of it may be seen
        pass
    nodes, edges = N.read(spark, path)
    at = N.version(spark, path)
    row = lambda df, name, of: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), of.cast("string").alias("of"), "n", F.lit(at).alias("version"))
    both = lambda df, name, key: row(df, name, F.lit(None)).unionByName(row(df.groupBy(key), name, F.col(key)))
    return both(nodes, "nodes", "kind").unionByName(both(edges, "edges", "type"))


def _manifest_update(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    one = lambda df, h: df.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), h.cast("string").alias("hash"), F.col("p_size").cast("long").alias("size"))
    old = one(p.where("p_size < 45"), F.col("p_size"))
    new = one(p.where("p_size > 5"), F.when(F.col("p_size") < 20, F.lit("x")).otherwise(F.col("p_size").cast("string")))
    return N.update_manifest(old, new)


def _context(spark, sf_dir):
    n, e = graph(spark, sf_dir)
    return N.context(n, e, focus=n.where(_START).first()["id"])


_LISTED = " union all ".join(f"select '{k}', name, 1 from (select name from nodes where kind = '{k}' order by name, id limit 100)" for k in N.LISTED)
_DANGLING = "(select count(*) from edges where src not in (select id from nodes) or dst not in (select id from nodes))"
_EDGE_KINDS = "('CONTAINS','IMPORTS','CALLS','EXPOSES','CONSUMES','READS','WRITES','TESTS','DEPENDS_ON','DOCUMENTS','CO_CHANGED')"
_FOCUS_SQL = _walk(_START, 5)[len(WITH) :].replace(" w as", " fw as").replace("from w ", "from fw ").replace(" met as", " fmet as").replace(", s as", ", fs as").replace("join s on", "join fs on")
_CONTEXT_SQL = f"""{_DOWN_SQL}{_FOCUS_SQL}
 select 'summary' as section, 'nodes' as item, count(*) as n from nodes union all select 'summary', 'edges', count(*) from edges
 union all select 'kinds', kind, count(*) from nodes group by kind union all select 'types', type, count(*) from edges group by type
 union all {_LISTED}
 union all select 'height', 'nodes', count(*) from nodes where kind in {_kinds('height')}
 union all select 'height', 'edges', count(*) from edges where type in {VIEWS['height'][1]} and src in (select id from nodes where kind in {_kinds('height')}) and dst in (select id from nodes where kind in {_kinds('height')})
 union all select 'highly_coupled', name, total from (select * from sc where total >= 4 order by total desc, name, id limit 8)
 union all select 'bottlenecks', name, n_in * n_out from (select * from sc where n_in >= 2 and n_out >= 2 order by n_in * n_out desc, name, id limit 8)
 union all select 'hubs', name, total from (select * from sc order by total desc, name, id limit 8)
 union all select 'isolated', name, 0 from (select * from sc where total = 0 and kind in ('Function','Method','Class','Module') order by name, id limit 8)
 union all select 'hotspots', name, downstream + total from (select * from dd where downstream >= 5 or (total >= 6 and downstream >= 2) order by downstream + total desc, name, id limit 8)
 union all select 'health', 'graph/nodes', count(*) from nodes union all select 'health', 'graph/edges', count(*) from edges union all select 'health', 'validation/errors', {_DANGLING}
 union all select 'health', 'edges/' || type, count(*) from edges where type in {_EDGE_KINDS} group by type
 union all select 'health', 'orphans/nodes', count(*) from nodes where id not in (select src from edges) and id not in (select dst from edges)
 union all select 'health', 'coverage/' || kind, count(*) from nodes where kind in ('Service','Function','API','Table','Test','External','Class') group by kind
 union all select 'policies', 'critical-must-have-tests', count(*) from nodes where critical and id not in (select dst from edges where type = 'TESTS')
 union all select 'verification', 'not_empty', (count(*) > 0)::int from nodes union all select 'verification', 'no_dangling', ({_DANGLING} = 0)::int
 union all select 'focus', kind, count(*) from fmet join nodes using (id) where depth > 0 group by kind"""

_VERIFY_SQL = """, t as (select distinct path from nodes where kind = 'Function' and path like 'orders/%'), c as (select unnest(['table:P7', 'O12', 'nowhere']) as claim),
  dangling as (select count(*) as n from edges where src not in (select id from nodes) or dst not in (select id from nodes))
  select 'not_empty' as name, count(*) > 0 as passed from nodes union all select 'no_dangling', n = 0 from dangling
  union all select 'inside_plan', (select count(*) from t where path not in (select path from t where path <> 'orders/F')) = 0
  union all select 'claim_' || claim, exists (select 1 from nodes where id = claim or name = claim or regexp_extract(id, '[^:]*$') = claim or regexp_extract(id, '[^/]*$') = claim) from c
  union all select 'no_unexplained_conflicts', count(*) = 0 from edges where type = 'PUBLISHES'"""

ALL = {
    "impact_paths": (_impact_paths, _chains(_MANY, 3) + "select source, id, depth, array_to_string(chain, ',') as path from f join nodes using (id) where kind in ('Table','API','External','Service','Event','Test')"),
    "shortest_paths": (_shortest, f"""{WITH}, ee as (select *, {EDGE_ID_SQL} as eid from edges), b as (select src as a, dst as b, eid from ee union all select dst, src, eid from ee where src <> dst),
      w1 as (select b as id, 1 as depth, [eid] as chain from b where a = 'svc:N3'), m1 as (select id, min(chain) as chain from w1 group by id),
      m2 as (select b as id, min(list_append(chain, eid)) as chain from m1 join b on a = id where b <> 'svc:N3' and b not in (select id from m1) group by b),
      m3 as (select b as id, min(list_append(chain, eid)) as chain from m2 join b on a = id where b <> 'svc:N3' and b not in (select id from m1) and b not in (select id from m2) group by b),
      m4 as (select b as id, min(list_append(chain, eid)) as chain from m3 join b on a = id where b <> 'svc:N3' and b not in (select id from m1) and b not in (select id from m2) and b not in (select id from m3) group by b)
      select 'svc:N3' as source, id, len(chain) as depth, array_to_string(chain, ',') as path from (select * from m1 union all select * from m2 union all select * from m3 union all select * from m4) join nodes using (id) where kind in ('Repo','API')"""),
    "impact_single_steps": (_single, _walk(_MANY, 2) + _RISKS_SQL + f""", ie as (select l.source, l.depth, {EDGE_ID_SQL} as eid from live l join edges e on
      (e.src = l.id and (e.type = 'EXPOSES' or (l.depth = 0 and (e.type in ('WRITES','PUBLISHES') or (e.type = 'CALLS' and e.dst in (select id from nodes where kind in ('External','API','Event')))))))
      or (e.dst = l.id and e.type in ('CALLS','CONSUMES','SUBSCRIBES','TESTS')))
      select source, arg_min(eid, (depth, eid)) as path from ie where source in (select source from reported where depth > 0 and kind not in ('File','Module')) group by source"""),
    "diff_impact": (_diff("impact"), _walk(f"id in {_DEBTORS}", 2) + "select id, kind, min(depth) as depth from met join nodes using (id) group by id, kind"),
    "diff_impact_symbols": (_diff("symbols"), f"select 'fn:customer/N' || c_nationkey || ':C' || c_custkey as id, 'signature_changed' as change from customer where {_DEBT}"),
    "diff_impact_fallback": (_diff("symbols", True), f"select 'fn:customer/N' || c_nationkey || ':C' || c_custkey as id, 'body_only' as change from customer where c_nationkey in (select c_nationkey from customer where {_DEBT})"),
    "impact_conflicts": (_conflicts, _walk(_MANY, 3) + _RISKS_SQL + "select distinct source, 'conflict' as kind, to_id as node_id from chip where type = 'WRITES'"),
    "policy_api_contract": (_graph(_api_policy), WITH + "select 'public-api-requires-contract' as policy, id as node_id from nodes where kind = 'API' and not (name < 'f') and id in (select dst from edges where type = 'CONSUMES')"),
    "verify_work": (_graph(_verify_work), WITH + _VERIFY_SQL),
    "budget_sums": (_budgets, "with c as (select conv_id as run, turn as seq, sum(coalesce(length(text), 0)) as i from conversations group by all), s as (select run, seq, count(*) over w as calls, sum(i) over w as input, 10 * count(*) over w as output from c window w as (partition by run order by seq)) select run, seq, calls, cast(input as bigint) as input, output, calls >= 6 or input >= 500 as blocked from s"),
    "find_node": (_graph(lambda n, e: C.find(n, "O12").unionByName(C.find(n, "table:P7")).select("id", "name")), WITH + ", h as (select id, name from nodes where name ilike '%O12%' or path ilike '%O12%' or id ilike '%O12%' order by name, id limit 1) select * from h union all select id, name from nodes where id = 'table:P7'"),
    "list_search": (_graph(lambda n, e: C.list_search(n, "ORDERS/f", "Function", None).select("id", "name")), WITH + "select id, name from nodes where kind = 'Function' and (contains(lower(name), 'orders/f') or contains(lower(id), 'orders/f') or contains(lower(path), 'orders/f'))"),
    "quick_pick": (_graph(lambda n, e: C.quick_pick(n, "3").unionByName(C.quick_pick(n)).select("id", "name")), WITH + ", o as (select id, name, row_number() over (order by name, id) as r from nodes where kind <> 'File') select id, name from o where r = 3 union all select id, name from o where r <= 20"),
    "degree_once": (_graph(lambda n, e: C.degree_once(e.unionByName(e.where("type = 'DEPENDS_ON'").withColumn("dst", F.col("src"))))), WITH + ", x as (select src, dst from edges union all select src, src from edges where type = 'DEPENDS_ON') select id, count(*) as degree from (select src as id from x union all select dst from x where src <> dst) group by id"),
    "replaced_graph": (_replaced, WITH + "select 'nodes' as item, kind as of, count(*) as n, 2 as version from nodes where kind <> 'Doc' group by grouping sets ((), (kind)) union all select 'edges', type, count(*), 2 from edges where type <> 'CONTAINS' group by grouping sets ((), (type))"),
    "manifest_update": (_manifest_update, "select 'p' || p_partkey as path, case when p_size < 20 then 'x' else cast(p_size as varchar) end as hash, cast(p_size as bigint) as size from part where p_size > 5"),
    "context_snapshot": (_context, _CONTEXT_SQL),
}

__all__ = ["ALL"]
