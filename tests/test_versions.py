"""Both versions of changed files from a git repository, and what a change of them does."""

import shutil
import subprocess

import pytest

from skein.operators.loops import settle
from skein.sources import versions

pytestmark = pytest.mark.skipif(shutil.which("git") is None, reason="needs git")


def _git(repo, *args):
    subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@example.com", "-c", "commit.gpgsign=false", *args], check=True, capture_output=True)


@pytest.fixture
def repo(tmp_path):
    at = tmp_path / "r"
    at.mkdir()
    _git(at, "init", "-q", "-b", "main")
    (at / "a.ts").write_text("export function one(x) {\n  return x;\n}\nexport function two(x) {\n  return x;\n}\n")
    (at / "gone.ts").write_text("export function gone() {\n  return 1;\n}\n")
    (at / "old name.ts").write_text("export function kept() {\n  return 1;\n}\nexport function also() {\n  return 2;\n}\n")
    (at / "yarn.lock").write_text("a\n")
    _git(at, "add", "-A")
    _git(at, "commit", "-qm", "first")
    _git(at, "checkout", "-qb", "work")
    (at / "a.ts").write_text("export function one(x, y) {\n  return x;\n}\nexport function two(x) {\n  return x + 1;\n}\nexport function three() {\n}\n")
    (at / "gone.ts").unlink()
    (at / "old name.ts").rename(at / "nëw.ts")
    (at / "yarn.lock").write_text("b\n")
    (at / "db" / "migrations").mkdir(parents=True)
    (at / "db" / "migrations" / "1.sql").write_text("create table t (a int);\n")
    return at


def _rows(df):
    return sorted((r["status"], r["path"], r["old_path"], r["side"]) for r in df.collect())


WANT = [
    ("A", "db/migrations/1.sql", None, "new"), ("D", "gone.ts", None, "old"), ("M", "a.ts", None, "new"), ("M", "a.ts", None, "old"),
    ("R", "nëw.ts", "old name.ts", "new"), ("R", "nëw.ts", "old name.ts", "old"),
]


def test_range_staged_and_working(spark, repo):
    loose = _rows(versions.file_versions(spark, str(repo)))  # renamed, not yet added: one gone, one loose
    assert loose == [r for r in WANT if r[0] != "R"][:1] + [("A", "nëw.ts", None, "new")] + [WANT[1], ("D", "old name.ts", None, "old")] + WANT[2:4]
    _git(repo, "add", "-A")
    (repo / "a.ts").write_text("changed after it was staged")
    staged = versions.file_versions(spark, str(repo), "staged", files_per_task=1)
    assert _rows(staged) == WANT and staged.rdd.getNumPartitions() >= len(WANT)
    assert "three" in staged.where("path = 'a.ts' and side = 'new'").first()["content"]
    working = versions.file_versions(spark, str(repo), "working")
    assert _rows(working) == WANT and working.where("path = 'a.ts' and side = 'new'").first()["content"] == "changed after it was staged"
    _git(repo, "checkout", "-q", "a.ts")
    _git(repo, "commit", "-qm", "second")
    assert _rows(versions.file_versions(spark, str(repo), base="main")) == WANT  # no head: HEAD
    back = versions.file_versions(spark, str(repo), base="work", head="main")  # three dots find nothing
    assert {(r["status"], r["path"]) for r in back.collect()} == {("D", "db/migrations/1.sql"), ("A", "gone.ts"), ("M", "a.ts"), ("R", "old name.ts")}
    assert versions.file_versions(spark, str(repo), "working").count() == 0
    assert versions.file_versions(spark, str(repo), base="main", head="main").count() == 0


def test_no_repository_no_commit(spark, tmp_path, repo):
    assert versions.file_versions(spark, str(tmp_path)).count() == 0
    assert versions.file_versions(spark, str(repo), base="--output=x", head="nowhere").columns == ["status", "path", "old_path", "side", "content"]
    with pytest.raises(Exception, match="mode is one of"):
        versions.file_versions(spark, str(repo), "other").count()


def test_filters_reach_the_source():
    reader = versions._Reader({"path": "x"})
    kept = list(reader.pushFilters([versions.EqualTo(("side",), "old"), versions.In(("status",), ("M", "R")), versions.EqualTo(("path",), "a")]))
    assert [f.attribute for f in kept] == [("path",)] and reader.wanted == {"side": {"old"}, "status": {"M", "R"}}
    assert reader._asked("side", "old") and not reader._asked("side", "new") and not reader._asked("status", "A")


def test_what_a_change_does(spark, repo):
    _git(repo, "add", "-A")
    _git(repo, "commit", "-qm", "second")
    ids = ["fn:a.ts:one", "fn:a.ts:two", "fn:a.ts:three", "fn:main.ts:run", "fn:far.ts:far"]
    nodes = spark.createDataFrame([(i, "Function", i.rsplit(":", 1)[1], i.split(":")[1]) for i in ids] + [("contract:db/migrations", "Contract", "m", "db/migrations")], "id string, kind string, name string, path string")
    edges = spark.createDataFrame([("e1", "CALLS", "fn:main.ts:run", "fn:a.ts:two", 1.0)], "id string, type string, src string, dst string, confidence double")
    found = versions.diff_versions(nodes, edges, versions.file_versions(spark, str(repo), base="main"))
    got = {r["id"]: (r["change"], r["old_signature"], r["new_signature"]) for r in found["symbols"].collect()}
    assert got["fn:a.ts:one"] == ("signature_changed", "export function one(x) {", "export function one(x, y) {")
    want = {"fn:a.ts:two": "body_only", "fn:a.ts:three": "added", "fn:gone.ts:gone": "removed", "fn:old name.ts:kept": "removed", "fn:old name.ts:also": "removed", "fn:nëw.ts:kept": "added", "fn:nëw.ts:also": "added"}
    assert {k: v[0] for k, v in got.items() if k.startswith("fn:")} == want | {"fn:a.ts:one": "signature_changed"}
    assert {(r["id"], r["depth"]) for r in found["impact"].collect()} == {("fn:a.ts:one", 0), ("fn:a.ts:two", 0), ("fn:a.ts:three", 0), ("fn:main.ts:run", 1)}
    assert {r["contract_id"] for r in found["contracts"].collect()} == {"contract:db/migrations", "contract:db/migrations/1.sql"}


def test_symbols_of_files(spark):
    """Each definition's own lines, told in its file's row: closed ones, open ones, other languages, digits behind braces, ids met twice."""
    files = [
        ("a.ts", "function one(x) {\r\n  const t = {1: '}'}; // }\r\n}2\r\nfunction two() {\n  /* } */ `{\n`\n}\nfunction one(y) {\n  return {0: y}; }\nrest\n"),
        ("open.ts", "class Outer {\n  inner(a) {\n    return {3: a};\n  }9\n}\nfunction never() {\n  x\n"),
        ("hid.ts", "const t = `\nfunction not() {\n}\n`;\n/* {\nfunction no() {}\n*/ function late() {\n}\n"),
        ("m.py", "class A:\n    def f(self):\n        return 1\n\nx = 1\n"), ("t.sql", "create table t (a int);\n"), ("none.ts", ""), ("read.me", "function x() {\n}\n"),
    ]
    df = spark.createDataFrame([("M", p, None, "new", t) for p, t in files], "status string, path string, old_path string, side string, content string")
    got = {r["id"]: (r["signature"], r["body"]) for r in versions.version_symbols(df, "new").collect()}
    assert got == {
        "fn:a.ts:one": ("function one(y) {", "  return {0: y}; }"), "fn:a.ts:two": ("function two() {", "  /* } */ `{\n`\n}"),
        "cls:open.ts:Outer": ("class Outer {", "  inner(a) {\n    return {3: a};\n  }9\n}"), "fn:open.ts:inner": ("  inner(a) {", "    return {3: a};\n  }9"),
        "fn:open.ts:never": ("function never() {", "  x\n"), "cls:m.py:A": ("class A:", "    def f(self):\n        return 1\n"), "fn:m.py:f": ("    def f(self):", "        return 1\n"),
        "table:t": ("create table t (a int);", ""),
    }


def test_texts_of_closed_files_are_not_shuffled(spark, monkeypatch):
    """Where each definition is closed and each path stands once, texts are read where they lie; copies of a file count once."""
    schema = "status string, path string, old_path string, side string, content string"
    one, two = "function a(x) {\n  y\n}\n", "function b(x) {\n  if (x) { y }\n}\n"
    rows = [("M", "a.ts", None, "old", one), ("M", "b.ts", None, "old", two), ("C", "c.ts", "a.ts", "old", one)]
    written = []
    monkeypatch.setattr(versions, "settle", lambda df: written.append(df.count()) or settle(df))
    plain = versions.version_symbols(settle(spark.createDataFrame(rows[:2], schema)), "old")
    assert not written
    plan = plain._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan
    copied = versions.version_symbols(settle(spark.createDataFrame(rows, schema)), "old")
    assert written == [2]
    want = {("fn:a.ts:a", "function a(x) {", "  y\n}"), ("fn:b.ts:b", "function b(x) {", "  if (x) { y }\n}")}
    assert {tuple(r) for r in plain.collect()} == want and {tuple(r) for r in copied.collect()} == want
    open_ = "class O {\n  m(a) {\n    x\n  }\n}\n"
    nested = versions.version_symbols(settle(spark.createDataFrame([("C", p, "o.ts", "old", open_) for p in ("p.ts", "q.ts")], schema)), "old")
    assert {tuple(r) for r in nested.collect()} == {("cls:o.ts:O", "class O {", "  m(a) {\n    x\n  }\n}"), ("fn:o.ts:m", "  m(a) {", "    x\n  }")}
