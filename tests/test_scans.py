"""Workspaces, nearest roots, ignore files, layers, dead exports, modules that do too much."""

import json
import random

import pytest

from skein.operators import scans
from skein.sources import files as S
from skein.sources import workspaces as W


def test_nearest_against_brute_force(spark):
    rng = random.Random(3)
    some = lambda: "/".join(rng.choice("ab") for _ in range(rng.randrange(1, 6)))
    paths, roots = sorted({some() for _ in range(60)}), sorted({some() for _ in range(15)})
    p, r = spark.createDataFrame([(x, i) for i, x in enumerate(paths)], "path string, n int"), [(x,) for x in roots]
    for extra in ([], [("",)]):
        got = {x["path"]: x["root"] for x in W.nearest(p, spark.createDataFrame(r + extra, "root string")).collect()}
        up = lambda x: max((y for (y,) in r + extra if x == y or y == "" or x.startswith(y + "/")), key=len, default=None)
        assert got == {x: up(x) for x in paths}
    keyed = W.nearest(p.withColumnRenamed("n", "w"), spark.createDataFrame([("a", 0)], "root string, w int"), ["w"])
    assert {x["root"] for x in keyed.where("w > 0").collect()} == {None}
    assert W.nearest(p.limit(0), spark.createDataFrame(r, "root string")).count() == 0


def _ws(spark, **files):
    rows = [(w, p, c) for w, held in files.items() for p, c in held.items()]
    return spark.createDataFrame(rows, "workspace string, path string, content string")


@pytest.fixture(scope="module")
def mono(spark):
    pkg = lambda **k: json.dumps(k)
    return _ws(
        spark,
        npm={"package.json": pkg(name="@x/top", workspaces={"packages": ["./a/", "b", "gone", "c/*"]}, dependencies={"@x/a": "1"}), "lerna.json": "{}", "a/package.json": pkg(name="@x/a", version="2", devDependencies={"bee": "1", "none": "1"}), "a/src/x.py": "", "a/deep/er/y.go": "", "b/package.json": pkg(name="bee", peerDependencies={"@x/a": "1", "bee": "1"}), "b/node_modules/z.rs": "", "sub/.git/HEAD": "", "sub/m.c": "", "sub/in/.git/HEAD": "", "node_modules/q/.git/HEAD": ""},
        lerna={"lerna.json": "{}"},
        turbo={"turbo.json": pkg(packages=["a"]), "nx.json": pkg(projects={"b": "x"}), "a/x.ts": ""},
        nx={"package.json": "{broken", "nx.json": pkg(projects={"b": "x", "c": "y"}), "b/k.KT": ""},
        pnpm={"pnpm-workspace.yaml": "packages:\nx: 'p'\n", "p/a.js": ""},
        rush={"rush.json": pkg(projects=[{"projectFolder": "f"}, {"path": "g"}]), "f/a": "", "g/b": None},
        usual={"apps/one/package.json": "{}", "libs/two/package.json": None, ".git/HEAD": ""},
        single={"apps/one/package.json": "{}"},
        far={"a/b/c/d/.git/x": "", "a/b/c/d2/e/.git/x": ""},
    )


def test_repositories(spark, mono):
    kinds = {r["workspace"]: (r["type"], r["packages"]) for r in W.monorepos(mono).collect()}
    assert kinds == {
        "npm": ("npm-workspaces", ["./a/", "b", "gone", "c/*"]), "lerna": ("lerna", ["packages/*"]), "turbo": ("turborepo", ["a"]), "nx": ("nx", ["b", "c"]),
        "pnpm": ("pnpm", ["p"]), "rush": ("rush", ["f", "g"]), "usual": ("unknown", ["apps/one", "libs/two"]),
    }
    repos = W.repositories(mono)
    got = {(r["workspace"], r["root"]): (r["name"], r["package"], r["version"], ",".join(r["languages"]), r["is_main"]) for r in repos.collect()}
    assert got == {
        ("npm", "a"): ("a", "@x/a", "2", "python", True), ("npm", "b"): ("bee", "bee", None, "", False), ("npm", "sub"): ("sub", None, None, "c", False), ("npm", ""): ("top", "@x/top", None, "c", True),
        ("turbo", "a"): ("a", None, None, "typescript", True), ("nx", "b"): ("b", None, None, "kotlin", True), ("nx", ""): ("nx", None, None, "kotlin", True), ("pnpm", "p"): ("p", None, None, "javascript", True),
        ("rush", "f"): ("f", None, None, "", True), ("rush", "g"): ("g", None, None, "", False), ("usual", "apps/one"): ("one", None, None, "", True), ("usual", "libs/two"): ("two", None, None, "", False),
        ("usual", ""): ("usual", None, None, "", True), ("far", "a/b/c/d"): ("d", None, None, "", True),
    }
    nodes, edges = W.workspace_graph(mono, repos)
    assert nodes.count() == len(got)
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {("repo:top", "repo:a"), ("repo:a", "repo:bee"), ("repo:bee", "repo:a")}


def test_ignore_files_in_folders(spark):
    rules = {".gitignore": "# no\n*.log\r\nbuild/\n/top.txt\n!keep.log\n(x+y)\n", "a/.gitignore": "!*.log\nb/*.ts\nq?z", "a/b/.gitignore": "!main.ts", "c/.gitignore": None}
    paths = ["x.log", "keep.log", "a/x.log", "build/a", "c/build/a", "top.txt", "c/top.txt", "(x+y)", "xxy", "a/b/n.ts", "a/b/main.ts", "a/c/n.ts", "a/qqz", "qqz", "a/b/c/qaz/f", "aa/x.log", "builds/x"]
    r = W.ignore_rules(spark.createDataFrame(list(rules.items()), "path string, content string"))
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {x["path"] for x in W.not_ignored(files, r).collect()} == {"keep.log", "a/x.log", "c/top.txt", "xxy", "a/b/main.ts", "a/c/n.ts", "qqz", "builds/x"}
    for p in ("*.log", "a/**/b", "x?y", "d/", "/e", "a.b+c"):  # the same language as the patterns of a scan
        got = W.ignore_rules(spark.createDataFrame([(".gitignore", p)], "path string, content string")).first()["regex"]
        want = S.ignore_regex(p)
        assert got.startswith("^") == want.startswith("^") or p == "/e"
    assert W.not_ignored(files, r.limit(0)).count() == len(paths)


def test_layers_against_brute_force(spark):
    rng = random.Random(11)
    for n, m in ((12, 14), (20, 26)):
        e = {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)}
        ids = sorted({x for p in e for x in p})
        reach = {x: {x} for x in ids}
        for _ in ids:
            for a, b in e:
                reach[a] |= reach[b]
        comp = {x: min(y for y in ids if y in reach[x] and x in reach[y]) for x in ids}
        low = {c: 0 for c in comp.values()}
        for _ in ids:
            for a, b in e:
                if comp[a] != comp[b]:
                    low[comp[a]] = max(low[comp[a]], low[comp[b]] + 1)
        got = {r["id"]: (r["layer"], r["component"]) for r in scans.layers(spark.createDataFrame(sorted(e), "src string, dst string")).collect()}
        assert got == {x: (low[comp[x]], comp[x]) for x in ids}


def test_layers_of_nothing(spark):
    assert scans.layers(spark.createDataFrame([], "src string, dst string")).count() == 0
    one = scans.layers(spark.createDataFrame([("a", "a"), (None, "b")], "src string, dst string")).collect()
    assert [tuple(r) for r in one] == [("a", 0, "a")]


def test_dead_exports_and_gods(spark):
    text = {"a.ts": "export const used = 1\nexport function once() {}\nexport class Never {}\nexport const ab = 2\nused; once; Never", "b.ts": "used(used)\nx.used\nonce", "c.ts": "once_more\nunused", "d.ts": None}
    files = spark.createDataFrame(list(text.items()), "path string, content string")
    assert {tuple(r) for r in scans.dead_exports(S.lines(files)).collect()} == {("a.ts", "once", 1), ("a.ts", "Never", 0)}
    many = "\n".join(["export class A {}"] * 3 + ["const f = async (x) => 1"] * 2)
    more = spark.createDataFrame([("g.ts", many), ("long.ts", "\n" * 400), ("fit.ts", "\n" * 399), ("n.ts", None)], "path string, content string")
    assert {tuple(r) for r in scans.god_modules(more).collect()} == {("g.ts", 5, 3, 2, 3, 16), ("long.ts", 401, 0, 0, 0, 0)}


def test_across_layers(spark):
    text = {"components/a.ts": "import x from '../db/y'\nimport z from './server'", "app/b.ts": "import z from './server'\nimport p from 'prisma'", "lib/c.ts": "import x from 'db'"}
    got = scans.across_layers(S.lines(spark.createDataFrame(list(text.items()), "path string, content string"))).collect()
    assert {(r["rule"], r["path"], r["line_no"]) for r in got} == {("ui to database", "components/a.ts", 1), ("client to server", "components/a.ts", 2), ("ui to database", "app/b.ts", 2)}
