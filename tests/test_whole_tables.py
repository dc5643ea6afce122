"""Queries over whole tables against their oracle SQL."""

import duckdb
import pytest

from skein.plans import catalog
from skein.plans.projection import occurrences

SF = "/root/testdata/sf0.001"
WHOLE = ("call_resolution", "debate_scores", "view_height", "view_call", "view_db", "edge_fold", "impact_tests", "compose_edges", "api_edges", "api_nodes", "nearest_root", "workspace_repos", "workspace_edges", "kept_paths", "dead_exports", "god_modules", "diff_versions", "diff_versions_impact")


@pytest.mark.parametrize("name", WHOLE)
def test_whole(spark, name):
    sql = catalog.oracle_sql()[name]
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    out = catalog.queries()[name](spark, SF)
    rel = con.sql(sql)
    assert out.count() > 0
    key = lambda r: tuple(repr(round(x, 6) if isinstance(x, float) else float(x) if type(x).__name__ == "Decimal" else x) for x in r)
    assert sorted(map(key, out.select(*rel.columns).collect())) == sorted(map(key, rel.fetchall()))


def test_occurrences_of_all_lines(spark):
    pairs = duckdb.sql(f"select l_partkey % 50 as p from '{SF}/lineitem.parquet' join '{SF}/orders.parquet' on l_orderkey = o_orderkey").fetchall()
    assert occurrences(spark, SF).count() == len(pairs)
    assert catalog.queries()["edge_fold"](spark, SF).count() == len(set(pairs))
