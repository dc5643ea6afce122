"""Composite operators on small frames."""

from pyspark.sql import functions as F

from skein.operators import composite as C


def test_workspace_and_cycles(spark):
    p = spark.createDataFrame([("a", "@x/core"), ("b", "web")], "repo string, package string")
    d = spark.createDataFrame([("b", "core"), ("a", "@x/core"), ("a", "none")], "repo string, dependency string")
    assert [tuple(r) for r in C.workspace_edges(p, d).collect()] == [("repo:b", "repo:a")]


def test_lines(spark):
    lines = spark.createDataFrame([("f", 1, "export function a() {"), ("f", 2, "  // note"), ("f", 3, ""), ("f", 4, "if (a && b) {"), ("f", 5, "apiKey = 'abcdefgh'")], "path string, line_no int, text string")
    assert tuple(C.file_statistics(lines).first()) == ("f", 3, 1, 1, 2, 1)
    assert [r["line_no"] for r in C.secrets(lines).collect()] == [5]
    docs = C.repo_docs(spark.createDataFrame([("README.md",), ("src/a.ts",), ("docs/x.txt",)], "path string"))
    assert {r["id"] for r in docs.collect()} == {"doc:README.md", "doc:docs/x.txt"}


def test_requests_and_summaries(spark):
    d = spark.createDataFrame([("refactor 'Cart total' now",), ("show the checkout",)], "q string")
    assert [tuple(r) for r in d.select(C.target_of(F.col("q")), C.tier(F.col("q"))).collect()] == [("Cart total", "strong"), ("checkout", "none")]
    m = spark.createDataFrame([("s", "s", "Function", 0), ("s", "t", "Table", 1), ("s", "u", "Function", 2), ("s", "v", "Function", 2)], "source string, id string, kind string, depth int")
    assert C.impact_summary(m).first()["text"] == "Reaches 2 Function, 1 Table"
    assert {r["kind"]: r["ids"] for r in C.affected(m).collect()} == {"Function": ["u", "v"], "Table": ["t"]}
