"""Lexer scan, ends of definitions, spans around points, bindings and components against brute force on random input."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from skein.operators import analytics as A
from skein.operators import cyclic, intervals
from skein.sources import binding, code, spans
from skein.sources.files import lines

PIECES = ["{", "}", "{", "}", "'", '"', "`", "//", "/*", "*/", "\\", "a", "x y", " ", "/", "*", "'a}'", '"{\\"{"', "`$", "{ }"]


def frame(spark, files):
    return spark.createDataFrame([(p, i + 1, t) for p, ls in files for i, t in enumerate(ls)], "path string, line_no int, text string")


def closing(ls, start):
    """The surveyed scan, character by character."""
    depth, mode, escaped = 0, None, False
    for i in range(start, len(ls)):
        k, line = 0, ls[i]
        while k < len(line):
            c, two = line[k], line[k : k + 2]
            if escaped or c == "\\":
                escaped = not escaped
            elif mode is None and two == "//":
                break
            elif mode in (None, "/*") and two == "/*":
                mode, k = "/*", k + 1
            elif mode == "/*":
                if two == "*/":
                    mode, k = None, k + 1
            elif c in "'\"`" and mode in (None, c):
                mode = None if mode else c
            elif mode is None and c in "{}":
                depth += 1 if c == "{" else -1
                if c == "}" and depth == 0:
                    return i
            k += 1
    return min(start + 100, len(ls) - 1)


def hidden(ls):
    out, mode = [False] * len(ls), None
    for i, line in enumerate(ls):
        out[i], escaped, k = mode is not None, False, 0
        while k < len(line):
            c, two = line[k], line[k : k + 2]
            if escaped or c == "\\":
                escaped = not escaped
            elif mode == "/*":
                if two == "*/":
                    mode, k = None, k + 1
            elif mode:
                mode = None if c == mode else mode
            elif two == "//":
                break
            elif two == "/*":
                mode, k = "/*", k + 1
            elif c in "'\"`":
                mode = c
                out[i] |= c == "`"
            k += 1
        mode = mode if mode in ("`", "/*") else None
    return out


@pytest.fixture(scope="module")
def rough():
    rng = random.Random(8)
    return [(f"f{n}", ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(1, 130))]) for n in range(200)]


def test_brace_ends(spark, rough):
    starts = [(p, random.Random(p).randrange(len(ls))) for p, ls in rough]
    df = spark.createDataFrame([(p, i + 1) for p, i in starts], "path string, line_no int")
    got = {(r["path"], r["line_no"]): r["end_line"] for r in spans.brace_ends(frame(spark, rough), df).collect()}
    assert got == {(p, i + 1): closing(dict(rough)[p], i) + 1 for p, i in starts}


def test_masked_lines(spark, rough):
    src = frame(spark, rough)
    got = {(r["path"], r["line_no"]): r["text"] for r in spans.masked_lines(src).collect()}
    assert got == {(p, i + 1): "" if h else ls[i] for p, ls in rough for i, h in enumerate(hidden(ls))}
    assert spans.masked_lines(src.limit(0)).count() == 0 and spans.brace_ends(src.limit(0), src.limit(0)).count() == 0


def test_nested_and_very_long_files(spark):
    body = [f"  f{i}() {{ if (x) {{ y('}}'); }}" if i % 2 else "  }" for i in range(1, 60_001)]
    files = spark.createDataFrame([("a.ts", "\n".join(["class A {", *body, "}"])), ("b.ts", "function g() { /* } */\n  return `{`;\n}\nfunction h() {\n")], "path string, content string")
    got = {(r["path"], r["symbol"]): (r["start_line"], r["end_line"]) for r in code.definitions(spans.masked_lines(lines(files)).withColumn("lang", F.lit("typescript")), lines(files)).collect()}
    assert got["a.ts", "A"] == (1, 60_002) and got["a.ts", "f1"] == (2, 3) and got["a.ts", "f59997"] == (59_998, 59_999) and len(got) == 30_003
    assert got["b.ts", "g"] == (1, 3) and got["b.ts", "h"] == (4, 5)


def test_indent_ends(spark):
    rng = random.Random(2)
    files = [(f"f{n}", [" " * rng.randint(0, 6) + rng.choice(["x", "", "y"]) for _ in range(rng.randint(1, 60))]) for n in range(120)]
    starts = [(p, i) for p, ls in files for i in range(len(ls)) if ls[i].strip() and rng.random() < 0.3]
    depth = lambda t: len(t) - len(t.lstrip())

    def end(ls, i):
        return next((j - 1 for j in range(i + 1, len(ls)) if ls[j].strip() and depth(ls[j]) <= depth(ls[i])), len(ls) - 1)

    got = {(r[0], r[1]): r[2] for r in spans.indent_ends(frame(spark, files), spark.createDataFrame([(p, i + 1) for p, i in starts], "path string, line_no int")).collect()}
    assert got == {(p, i + 1): end(dict(files)[p], i) + 1 for p, i in starts}


def test_intervals(spark):
    rng = random.Random(5)
    sp = [(rng.choice("ab"), lo, lo + rng.choice([-1, 0, 3, 40, 900]), f"s{i}") for i, lo in enumerate(rng.randint(0, 300) for _ in range(300))] + [("a", None, 5, "n"), (None, 0, 9, "m")]
    pt = [(rng.choice("ab"), rng.randint(0, 1300)) for _ in range(400)] + [("a", None), (None, 4), ("c", 7)]
    s, p = spark.createDataFrame(sp, "k string, low int, high int, name string"), spark.createDataFrame(pt, "k string, at int")
    met = sorted((k, a, n) for k, a in pt for q, lo, hi, n in sp if None not in (k, a, q, lo) and q == k and lo <= a <= hi)
    assert sorted((r["k"], r["at"], r["name"]) for r in intervals.stab(p, s, ["k"]).collect()) == met
    best = {}
    for k, a, n in met:
        lo = next(x[1] for x in sp if x[3] == n)
        best[k, a] = min(best.get((k, a), (1, "")), (-lo, n)) if (k, a) in best else (-lo, n)
    assert {(r["k"], r["at"]): r["name"] for r in intervals.innermost(p, s, ["k"], "name").collect()} == {k: v[1] for k, v in best.items()}
    assert intervals.stab(p, s.limit(0), ["k"]).count() == 0
    marks = spark.createDataFrame([("a", 10, "t2"), ("a", 10, "t1"), ("a", 3, "t0"), ("b", 900, "u")], "k string, at int, name string")
    assert {(r["at"], r["name"]) for r in intervals.first_before(p.where("k = 'a'"), marks, ["k"], "name").collect()} == {(a, "t0" if a is not None and a >= 3 else None) for k, a in pt if k == "a"}


def test_bindings_and_cascade(spark):
    text = {
        "src/a.ts": "import { one as uno, two } from './b';\nimport Big from \"@scope/big/part\";\nimport * as pay from '../lib/pay';\nconst ext = require('express');\nconst k = new Klass();\nlet far = new Far();\n"
        "function run(x) {\n  uno(); two(); Big(); pay.charge(); ext.listen(); k.go(); far.away(); local(); other(); inPay(); _z.free(); this.no(); nowhere();\n}\nfunction local() {\n}\nclass Klass {\n}\n",
        "src/b.ts": "export function one() {\n}\nexport function two() {\n}\n", "lib/pay.ts": "export function charge() {\n}\nfunction inPay() {\n}\nfunction free() {\n}\n", "c.ts": "class Far {\n}\nfunction other() {\n}\nfunction inPay() {\n}\n",
        "app/main.py": "from pkg.tool import use as u, drop\nimport pkg.util as pu\nimport os\n\ndef main():\n    u(drop(pu.work(os.getcwd())))\n", "deep/pkg/tool.py": "def use():\n    pass\n\ndef drop():\n    pass\n", "deep/pkg/util.py": "def work():\n    pass\n", "z/pkg/util.py": "",
        "t/x.test.ts": "import { one } from '../src/b';\nfunction early() {\n  one();\n}\nit('does it', () => {});\nfunction late() {\n  one();\n}\n",
    }
    nodes, edges = code.parse(spark.createDataFrame(list(text.items()), "path string, content string"))
    e = {(r["src"], r["dst"]): r["confidence"] for r in edges.where("type = 'CALLS'").collect()}
    run = "fn:src/a.ts:run"
    want = {"fn:src/b.ts:one": 0.95, "fn:src/b.ts:two": 0.95, "ext:@scope/big": 0.8, "fn:lib/pay.ts:charge": 0.95, "ext:express": 0.8, "fn:src/a.ts:local": 1.0, "fn:c.ts:other": 0.75, "fn:lib/pay.ts:inPay": 0.9, "fn:lib/pay.ts:free": 0.9}
    want |= {"cls:c.ts:Far": 0.75, "cls:src/a.ts:Klass": 1.0}  # the two lines above a function count as its own
    assert {d: c for (s, d), c in e.items() if s == run} == want
    main = "fn:app/main.py:main"
    assert {d: c for (s, d), c in e.items() if s == main} == {"fn:deep/pkg/tool.py:use": 0.95, "fn:deep/pkg/tool.py:drop": 0.95, "fn:deep/pkg/util.py:work": 0.95, "ext:os": 0.8}
    tests = {(r["src"], r["dst"]) for r in edges.where("type = 'TESTS'").collect()}
    assert tests == {("test:t/x.test.ts:file", "fn:src/b.ts:one"), ("test:t/x.test.ts:does_it", "fn:src/b.ts:one")}
    calls = spark.createDataFrame([("x", "k", "go"), ("x", "far", "away")], "path string, receiver string, name string")
    defs = spark.createDataFrame([("K", "x", "cls:x:K", 1), ("F", "y", "cls:y:F", 1)], "symbol string, path string, id string, seq int")
    none = spark.createDataFrame([], "path string, local string, name string, file string, package string, seq int")
    held = spark.createDataFrame([("x", "k", "Old", 1), ("x", "k", "K", 2), ("x", "far", "F", 1)], "path string, local string, class string, seq int")
    got = {(r["callee"], r["confidence"], r["way"]) for r in binding.resolve(calls, defs, none, none.drop("name"), held).collect()}
    assert got == {("fn:x:go", 0.9, "own_class"), ("fn:y:away", 0.8, "other_class")}


def test_suffix_modules(spark):
    files = spark.createDataFrame([("a/my_util.py", 2), ("b/util.py", 1), ("util.py", 3), ("x/pkg/mod.py", 4), ("y/pkg/mod.py", 5), ("", 0)], "path string, seq int")
    asked = ["util.py", "pkg/mod.py", "kg/mod.py", "none.py", "", None, "util.py"]
    got = [(r["target"], r["file"]) for r in binding.suffix_modules(spark.createDataFrame([(t,) for t in asked], "target string"), files).collect()]
    assert sorted(got, key=repr) == sorted([("util.py", "b/util.py"), ("util.py", "b/util.py"), ("pkg/mod.py", "x/pkg/mod.py"), ("kg/mod.py", "x/pkg/mod.py"), ("none.py", None), ("", None), (None, None)], key=repr)


def tarjan(pairs):
    sys.setrecursionlimit(10_000)
    after, number, low, stack, out = {}, {}, {}, [], {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])

    def go(v):
        number[v] = low[v] = len(number)
        stack.append(v)
        for w in after[v]:
            if w not in number:
                go(w)
            if w in stack:
                low[v] = min(low[v], low[w])
        if low[v] == number[v]:
            comp = stack[stack.index(v) :]
            del stack[stack.index(v) :]
            if len(comp) > 1:
                out.update({w: (min(comp), len(comp)) for w in comp})

    for v in after:
        if v not in number:
            go(v)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components(spark, seed):
    rng = random.Random(seed)
    e = [(f"n{rng.randrange(90):03}", f"n{rng.randrange(90):03}") for _ in range(100)]
    e += [(f"r{i:03}", f"r{(i + 1) % 100:03}") for i in range(100)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(150)]
    e += [("u", "p"), ("p", "u"), ("u", "a"), ("a", "w"), ("w", "a"), ("a", "b"), ("b", "u"), ("self", "self")]  # loops inside a ring
    if seed == 2:
        e += [("n001", "r005"), ("c150", "n002"), ("n002", "c000")]
    got = {r["id"]: (r["component"], r["size"]) for r in cyclic.strong_components(spark.createDataFrame([*e, e[0], ("x", None)], "src string, dst string")).collect()}
    assert got == tarjan([x for x in e if x[0] != x[1]])


def test_cycles_of_any_length(spark):
    ring = [("IMPORTS", f"r{i:02}", f"r{(i + 1) % 20:02}") for i in range(20)] + [("CALLS", "r05", "r03"), ("READS", "r01", "r00"), ("CALLS", "r09", "z")]
    e = spark.createDataFrame([(f"e{i}", *x) for i, x in enumerate(ring)], "id string, type string, src string, dst string")
    got = {r["id"]: r["length"] for r in A.cycle_members(e).collect()}
    assert got == {f"r{i:02}": 3 if i in (3, 4, 5) else 20 for i in range(20)}
    assert {r["id"] for r in A.cycle_members(e, 5).collect()} == {"r03", "r04", "r05"}
    assert [(r["length"], r["path"][0]) for r in A.cycles(e).collect()] == [(3, "r03"), (20, "r00")]
    assert A.cycles(e.where("type = 'READS'")).count() == 0


def test_suffix_tails_are_not_broadcast(spark):
    """The files' table is small and its tails are not: the driver holds neither them nor the files found."""
    files = spark.createDataFrame([("src/a/m.py", 2), ("lib/a/m.py", 1), ("lib/a/m.py", 3)], "path string, seq long")
    targets = spark.range(200_000).select(F.concat(F.lit("a/m"), F.when(F.col("id") % 2 == 0, "").otherwise(F.col("id").cast("string")), F.lit(".py")).alias("target"))
    found = binding.suffix_modules(targets, files)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.groupBy("file").count().collect()), key=str) == sorted([("lib/a/m.py", 100_000), (None, 100_000)], key=str)


def test_lines_and_ends_of_files_in_their_own_rows(spark, rough):
    """Blanking lines moves no row, and files given whole end as their lines do, across restarts and nested definitions."""
    files = spark.createDataFrame([(p, "\n".join(ls)) for p, ls in rough], "path string, content string")
    src = code.source_lines(files)
    plan = src._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    assert {(r["path"], r["line_no"]): r["text"] for r in src.collect()} == {(p, i + 1): "" if h else ls[i] for p, ls in rough for i, h in enumerate(hidden(ls))}
    starts = spark.createDataFrame([(p, i + 1) for p, ls in rough for i in range(len(ls)) if random.Random(p + str(i)).random() < 0.1], "path string, line_no int")
    ends = lambda *more: sorted(map(tuple, spans.brace_ends(frame(spark, rough), starts, *more).collect()))
    assert ends() == ends(files) and len(ends()) == starts.count()
