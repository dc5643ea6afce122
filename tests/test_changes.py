"""Chains, changes, pickers, versions and snapshots on small graphs."""

import pytest
from pyspark.sql import functions as F

from skein.operators import analytics as A
from skein.operators import changes as C
from skein.operators import paths as P
from skein.operators import snapshot as N
from skein.operators import store
from skein.operators import traverse as T
from skein.operators.composite import target_of
from skein.plans import catalog

NODES = "id string, kind string, name string, path string, tags array<string>"
EDGES = "id string, type string, src string, dst string"


@pytest.fixture(scope="module")
def small(spark):
    nodes = [("fn:a", "Function", "a", "x.ts", []), ("fn:b", "Function", "b", "x.ts", []), ("fn:c", "Function", "c", "y.ts", []), ("table:t", "Table", "t", None, ["critical"]), ("test:u", "Test", "u", "u.ts", []), ("file:x", "File", "0x", "x.ts", [])]
    edges = [("e1", "CALLS", "fn:b", "fn:a"), ("e2", "CALLS", "fn:c", "fn:b"), ("e3", "WRITES", "fn:a", "table:t"), ("e4", "TESTS", "test:u", "fn:c"), ("e0", "CALLS", "fn:c", "fn:a"), ("e5", "CONTAINS", "file:x", "fn:a")]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def start(spark, *ids):
    return spark.createDataFrame([("s", i) for i in ids], "source string, id string")


def test_chains(spark, small):
    n, e = small
    got = {r["id"]: r["path"] for r in P.impact_paths(n, e, start(spark, "fn:a", "fn:none")).collect()}
    assert got == {"table:t": ["e3"], "test:u": ["e0", "e4"]}
    assert P.impact_paths(n, e, start(spark, "fn:a"), max_paths=1).count() == 1
    far = P.shortest_paths(e, start(spark, "table:t"), spark.createDataFrame([("test:u",), ("gone",)], "id string"))
    assert [r["path"] for r in far.collect()] == [["e3", "e0", "e4"]]
    twice = spark.createDataFrame([("s", "x", 1, ["e"]), ("s", "x", 1, ["e"]), ("s", "y", 0, [])], "source string, id string, depth int, path array<string>")
    assert P.unique_paths(twice).count() == 1


def test_why_falls_back_to_one_edge(spark, small):
    n, e = small
    plain = n.where("kind in ('Function', 'File')")
    met = spark.createDataFrame([("s", "fn:a", 0), ("s", "fn:b", 1), ("s", "fn:c", 1)], "source string, id string, depth int")
    assert [tuple(r)[1:] for r in P.impact_why(plain, e.where("type = 'CALLS'"), met, "fn:a").select("source", "depth", "path").collect()] == [(1, ["e0"])]
    found = P.impact_why(n, e, met.union(spark.createDataFrame([("s", "table:t", 1)], met.schema)), "fn:a").collect()
    assert {tuple(r["path"]) for r in found} == {("e3",), ("e0", "e4")}


def test_diff_impact(spark, small):
    n, e = small
    sym = "id string, signature string, body string"
    old = spark.createDataFrame([("fn:a", "a()", "1"), ("fn:b", "b()", "1"), ("fn:gone", "g()", "1")], sym)
    new = spark.createDataFrame([("fn:a", "a(x)", "1"), ("fn:b", " b() ", "1")], sym)
    changed = spark.createDataFrame([("x.ts",), ("api/openapi.json",)], "path string")
    out = C.diff_impact(n, e, old, new, changed)
    assert {r["id"]: r["change"] for r in out["symbols"].collect()} == {"fn:a": "signature_changed", "fn:gone": "removed"}
    assert {r["id"]: r["depth"] for r in out["impact"].collect()} == {"fn:a": 0, "fn:b": 1, "fn:c": 1, "table:t": 1, "test:u": 2}
    assert [r[0] for r in out["contracts"].collect()] == ["contract:api/openapi.json"]
    same = C.diff_impact(n, e, old, old, changed)
    assert {(r["id"], r["change"]) for r in same["symbols"].collect()} == {("fn:a", "body_only"), ("fn:b", "body_only")}


def test_verify_work(spark, small):
    n, e = small
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    claims = spark.createDataFrame([("a",), ("zzz",)], "claim string")
    got = {r["name"]: r["passed"] for r in C.verify_work(n, e, claims, touched=paths("x.ts")).collect()}
    assert got == {"not_empty": True, "no_dangling": True, "envelope_required": False, "claim_a": True, "claim_zzz": False}
    ok = {r["name"]: r["passed"] for r in C.verify_work(n, e.withColumn("conflict", F.lit(False)), allowed=paths("x.ts"), touched=paths("x.ts")).collect()}
    assert ok["inside_plan"] and ok["no_unexplained_conflicts"]


def test_pickers(spark, small):
    n, e = small
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(C.find(n, "fn:b")) == ["fn:b"] and ids(C.find(n, "FN:")) == ["fn:a"] and ids(C.find(n, "none")) == []
    assert ids(C.list_search(n, "X.T")) == ["file:x", "fn:a", "fn:b"]
    assert ids(C.quick_pick(n)) == ["fn:a", "fn:b", "fn:c", "table:t", "test:u"]
    assert ids(C.quick_pick(n, " 2 ")) == ["fn:b"] and ids(C.quick_pick(n, "TABLE")) == ["table:t"]
    assert ids(C.quick_pick(n.where("kind = 'File'"))) == ["file:x"]
    loop = e.union(spark.createDataFrame([("e9", "CALLS", "fn:a", "fn:a")], EDGES))
    assert {r["id"]: r["degree"] for r in C.degree_once(loop).collect()}["fn:a"] == 5
    assert [r["node_id"] for r in C.flow_from(n, e, "c").collect()] == ["fn:c", "fn:a", "table:t"]
    assert C.flow_from_api(n, e, "get", "/x").count() == 0


def test_budgets(spark):
    calls = spark.createDataFrame([("r", 1, 10, 1, 1.0), ("r", 2, 90, 1, 2.0), ("q", 1, 1, 1, 400.0)], "run string, seq int, input long, output long, seconds double")
    got = {(r["run"], r["seq"]): (r["input"], r["blocked"]) for r in C.budgets(calls, max_input=100).collect()}
    assert got == {("r", 1): (10, False), ("r", 2): (100, True), ("q", 1): (1, True)}


def test_replace_and_transaction(spark, small, tmp_path):
    n, e = small
    at = f"file://{tmp_path}/g"
    N.replace(at, n, e)
    assert N.read(spark, at)[0].count() == n.count() and N.read(spark, at)[1].count() == e.count()
    N.transaction(spark, at, lambda g: (g[0].where("kind = 'Function'"), g[1]))
    with pytest.raises(ZeroDivisionError):
        N.transaction(spark, at, lambda g: 1 / 0)
    with pytest.raises(Exception, match="no such"):
        N.transaction(spark, at, lambda g: (g[0].limit(0), g[1].select(F.raise_error(F.lit("no such")))))
    assert N.read(spark, at)[0].count() == n.where("kind = 'Function'").count() and N.read(spark, at)[1].count() == e.count()


def test_versions_of_a_stored_graph(spark, small, tmp_path):
    n, e = small
    at = f"file://{tmp_path}/v"
    assert N.version(spark, at) == 0
    N.replace(at, n, e)
    N.transaction(spark, at, lambda g: (g[0].where("kind = 'Function'"), g[1]))
    with pytest.raises(ZeroDivisionError):
        N.transaction(spark, at, lambda g: 1 / 0)
    assert N.version(spark, at) == 2

    def overtaken(g):
        N.replace(at, n, e)
        return g[0].limit(0), g[1]

    with pytest.raises(RuntimeError, match="version 2"):
        N.transaction(spark, at, overtaken)
    assert N.version(spark, at) == 3 and N.read(spark, at)[0].count() == n.count()


def test_replaced_graph_tells_sizes_and_version(spark):
    rows = catalog.queries()["replaced_graph"](spark, "/root/testdata/sf0.001").collect()
    for item in ("nodes", "edges"):
        own = [r for r in rows if r["item"] == item]
        assert [r["n"] for r in own if r["of"] is None] == [sum(r["n"] for r in own if r["of"] is not None)]
    assert {r["version"] for r in rows} == {2}


def test_snapshots(spark, small, tmp_path):
    n, e = small
    at = f"file://{tmp_path}/context"
    schema = "section string, item string, n long"
    assert N.read_json(spark, at, schema) is None
    rows = N.context(n, e, focus="fn:a", cycle_length=3)
    N.save_json(rows, at)
    got = {(r["section"], r["item"]): r["n"] for r in N.read_json(spark, at, schema).collect()}
    assert got["summary", "nodes"] == 6 and got["types", "CALLS"] == 3 and got["insights", "cycles"] == 0 and got["focus", "Table"] == 1
    old = spark.createDataFrame([("a", "1", 1), ("b", "1", 1), ("c", "1", 1)], "path string, hash string, size long")
    new = spark.createDataFrame([("a", "1", 1), ("b", "2", 2), ("d", "1", 4)], "path string, hash string, size long")
    assert sorted(map(tuple, N.update_manifest(old, new).collect())) == sorted(map(tuple, new.collect()))


def test_finders(spark):
    one = lambda col, *v: spark.createDataFrame([(x,) for x in v], f"{col} string")
    files = one("path", "a/lcov.info", "coverage/coverage-final.json", "node_modules/x/lcov.info", "src/a.ts")
    assert {tuple(r) for r in C.coverage_files(files).collect()} == {("coverage/coverage-final.json", 2), ("a/lcov.info", 6)}
    assert C.base_ref(one("ref", "HEAD", "master", "dev")).first()[0] == "master" and C.base_ref(one("ref", "dev")).first()[0] == "HEAD"
    rows = [("f", 1, "function a() {", "a"), ("f", 2, "  b(); c()", "a"), ("g", 1, "a()", "main"), ("g", 2, "main()", None)]
    lines = spark.createDataFrame(rows, "path string, line_no int, text string, caller string")
    assert [(r["depth"], r["callee"], r["caller"]) for r in C.chain_of(lines, "b").collect()] == [(1, "b", "a"), (2, "a", "main"), (3, "main", None)]


def test_small_views_and_targets(spark, small):
    n, e = small
    nodes, _ = A.view(n, e, "api")
    assert {r["kind"] for r in nodes.collect()} == {"Function", "Table", "Test"}
    d = spark.createDataFrame([("please modify checkout.total today",)], "q string")
    assert d.select(target_of(F.col("q"))).first()[0] == "checkout.total"


def test_walks_write_no_steps(spark, small, monkeypatch):
    """What is written between rounds is what was met, never the graph's edges once more."""
    n, e = small
    written = []
    keep = T.settle
    for m in (T, P):
        monkeypatch.setattr(m, "settle", lambda df: written.append(set(df.columns)) or keep(df))
    start = n.where("id = 'fn:a'").select(F.col("id").alias("source"), "id")
    met = T.reach(n, e, start, max_depth=2)
    assert T.impact_risks(n, e, met).where("kind = 'db_write'").count() == 1
    assert [r["depth"] for r in P.shortest_paths(e, start, n.where("kind = 'Table'")).collect()] == [1]
    assert not any("start_only" in w for w in written)


def test_a_snapshot_leaves_no_large_shuffles(spark):
    """Each part is written alone: no exchange is left in the plan, and edges count once however often an end has a node."""
    nodes = spark.createDataFrame([("fn:a", "Function", "a", None, None), ("fn:a", "Function", "a", None, None), ("t:b", "Table", "b", None, None)], "id string, kind string, name string, path string, tags array<string>")
    edges = spark.createDataFrame([("e1", "WRITES", "fn:a", "t:b"), ("e2", "WRITES", "fn:a", "t:none"), ("e3", "WRITES", None, "t:b"), ("e4", "CALLS", "fn:a", "fn:x")], "id string, type string, src string, dst string")
    assert sorted(r["id"] for r in store.dangling(nodes, edges).collect()) == ["e2", "e3", "e4"]
    out = N.context(nodes, edges)
    got = {(r["section"], r["item"]): r["n"] for r in out.collect()}
    assert got["health", "validation/errors"] == 3 and got["verification", "no_dangling"] == 0 and got["summary", "edges"] == 4
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
