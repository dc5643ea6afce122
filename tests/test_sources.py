"""Parsing of a small invented repository, reports and streams."""

import json

from pyspark.sql import functions as F

from skein.operators import mining as M
from skein.sources import code, files, manifests
from skein.streaming import stateful

FILES = {
    "src/shop/cart.ts": "import { total } from './sum';\nimport axios from 'axios';\n\nexport function addItem(x) {\n  total(x);\n  db.query('INSERT INTO carts VALUES (1)');\n  bus.emit('cart.added', x);\n}\n\nexport const list = (q) => {\n  return db.query(\"SELECT * FROM carts\");\n}\n",
    "src/shop/sum.ts": "/*\nfunction hidden() {\n*/\nexport function total(x) {\n  return x;\n}\n",
    "src/routes.ts": "import { addItem } from './shop/cart';\nrouter.post('/cart', addItem);\nfunction boot() {\n  addItem(1);\n}\n",
    "tests/cart.test.ts": "import { addItem } from '../src/shop/cart';\nit('adds items', () => {});\nfunction check() {\n  addItem(2);\n}\n",
    "py/app.py": "from py.util import helper\n\n@app.route('/ping')\ndef ping():\n    return helper()\n",
    "py/util.py": "class Base:\n    def run(self):\n        return 1\n\ndef helper():\n    return Base()\n",
    "db/schema.sql": "CREATE TABLE carts (id int);\n",
    "README.md": "text\n# The Shop\n",
    "package.json": json.dumps({"name": "shop", "dependencies": {"axios": "1"}, "peerDependencies": {"react": "2"}, "devDependencies": {"x": "3"}}),
    "openapi.json": json.dumps({"paths": {"/cart": {"post": {"operationId": "add", "tags": ["a"]}, "parameters": {}}}}),
    "node_modules/a.js": "function no() {}\n",
    "out/skip.ts": "function no() {}\n",
}


def made(spark):
    return spark.createDataFrame([(k, v) for k, v in FILES.items()], "path string, content string")


def test_scan_ignores(spark, tmp_path):
    for k, v in FILES.items():
        (tmp_path / k).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / k).write_text(v)
    got = {r["path"] for r in files.scan(spark, str(tmp_path), ["out/", "*.sql", "!db/schema.sql"]).collect()}
    assert got == set(FILES) - {"node_modules/a.js", "out/skip.ts"}


def test_parse(spark):
    f = made(spark).where("not path like 'node%' and not path like 'out%'")
    nodes, edges = code.parse(f)
    n, e = {r["id"]: r["kind"] for r in nodes.collect()}, {(r["type"], r["src"], r["dst"]) for r in edges.collect()}
    assert n["fn:src/shop/cart.ts:addItem"] == n["fn:src/shop/cart.ts:list"] == "Function" and n["table:carts"] == "Table"
    assert "fn:src/shop/sum.ts:hidden" not in n and n["cls:py/util.py:Base"] == "Class" and n["fn:py/util.py:run"] == "Method"
    assert n["ext:axios"] == "External" and n["test:tests/cart.test.ts:adds_items"] == "Test" and n["event:cart.added"] == "Event"
    want = {
        ("IMPORTS", "file:src/shop/cart.ts", "file:src/shop/sum.ts"), ("IMPORTS", "file:src/shop/cart.ts", "ext:axios"), ("IMPORTS", "file:tests/cart.test.ts", "file:src/shop/cart.ts"),
        ("IMPORTS", "file:py/app.py", "file:py/util.py"), ("CALLS", "fn:src/shop/cart.ts:addItem", "fn:src/shop/sum.ts:total"), ("CALLS", "fn:src/routes.ts:boot", "fn:src/shop/cart.ts:addItem"),
        ("TESTS", "test:tests/cart.test.ts:adds_items", "fn:src/shop/cart.ts:addItem"), ("CALLS", "fn:tests/cart.test.ts:check", "fn:src/shop/cart.ts:addItem"), ("WRITES", "fn:src/shop/cart.ts:addItem", "table:carts"), ("READS", "fn:src/shop/cart.ts:list", "table:carts"),
        ("PUBLISHES", "fn:src/shop/cart.ts:addItem", "event:cart.added"), ("CONTAINS", "file:src/routes.ts", "fn:src/routes.ts:boot"), ("EXPOSES", "fn:py/app.py:ping", "api:GET:/ping"), ("CALLS", "fn:py/app.py:ping", "fn:py/util.py:helper"),
    }
    assert want <= e, want - e
    assert not {x for x in e if x[1] not in n or x[2] not in n}


def test_manifests(spark):
    f = made(spark)
    assert {(r["dependency"], r["version"]) for r in manifests.packages(f).collect()} == {("axios", "1"), ("react", "2")}
    assert manifests.markdown_titles(f).first()["title"] == "The Shop"
    assert [tuple(r) for r in manifests.openapi(f).collect()] == [("openapi.json", "POST", "/cart", "add", "a")]
    one = lambda c: spark.createDataFrame([("x", c)], "path string, content string")
    assert [tuple(r) for r in manifests.lcov(one("TN:\nSF:a.ts\nDA:1,2\nDA:x\nSF:b.ts\nDA:3,0")).orderBy("file").collect()] == [("a.ts", 1, 2), ("b.ts", 3, 0)]
    cov = json.dumps({"a.ts": {"statementMap": {"0": {"start": {"line": 4}}, "1": {"start": {"line": 5}}}, "s": {"0": 2, "1": 0}}})
    assert [tuple(r) for r in manifests.istanbul(one(cov)).collect()] == [("a.ts", 4, 2)]
    log = spark.createDataFrame(list(enumerate(["COMMIT_a", "f1", "f2", "", "COMMIT_b", "f1"])), "line_no int, text string")
    assert {tuple(r) for r in manifests.git_log(log).collect()} == {("a", "f1"), ("a", "f2"), ("b", "f1")}
    assert {tuple(r) for r in manifests.git_log(log, block=2).collect()} == {("a", "f1"), ("a", "f2"), ("b", "f1")}
    assert {tuple(r) for r in manifests.git_log(log, most=1, block=1).collect()} == {("a", "f1"), ("a", "f2")}
    st = spark.createDataFrame([("M\ta.ts",), ("R100\told\\x.ts\tnew.ts",), ("A\tyarn.lock",), ("",)], "text string")
    assert {tuple(r) for r in manifests.name_status(st).collect()} == {("M", "a.ts", None), ("R", "new.ts", "old/x.ts")}
    own = manifests.owners(one("# c\n*.ts @a @b\n\ndocs/ @c x"))
    assert {(r["line"], r["pattern"], tuple(r["owners"])) for r in own.collect()} == {(2, "*.ts", ("@a", "@b")), (4, "docs/", ("@c",))}
    proto = spark.createDataFrame([("a.proto", "service S {\n  rpc Get (Req) returns (stream Res) {}\n}\nmessage Req {\n  string a = 1;\n  int32 b = 2;\n}\n")], "path string, content string")
    assert [tuple(r) for r in manifests.protobuf(proto).collect()] == [("a.proto", "S", "Get", "Req", "Res")] and manifests.messages(proto).first()["fields"] == 2
    tf = spark.createDataFrame([("m.tf", 'resource "aws_x" "main" {\n}\nprovider "aws" {\n}\n')], "path string, content string")
    assert {tuple(r) for r in manifests.terraform(tf).collect()} == {("m.tf", "resource", "aws_x", "main"), ("m.tf", "provider", None, "aws")}


def test_symbol_diff_of_sources(spark):
    old = "function greet(n) {\n  return n;\n}\nfunction unused() {\n}\n"
    pairs = {"body_only": old.replace("return n;", "return n + 1;"), "signature_changed": old.replace("greet(n)", "greet(n, m)"), "removed": "function greet(n) {\n  return n;\n}\nfunction fresh() {\n}\n"}

    def symbols(text):
        f = spark.createDataFrame([("src/greet.ts", text)], "path string, content string")
        d = code.definitions(code.source_lines(f)).join(f, "path")
        return M.bodies(d, F.col("content")).select("id", "signature", "body")

    for change, new in pairs.items():
        got = {r["id"].split(":")[-1]: r["change"] for r in M.symbol_diff(symbols(old), symbols(new)).collect()}
        assert got == ({"unused": "removed", "fresh": "added"} if change == "removed" else {"greet": change})


def test_circuit_breaker_steps():
    s = (None, 0, 0, 0, False, 0)
    for k in range(5):
        s = stateful.step(s, k * 1000, True)
    assert s[4] and s[3] == 5
    assert stateful.step(s, 5000, False)[4]
    s = stateful.step(s, 4000 + stateful.COOLDOWN_MS + 1, False)
    assert not s[4] and s[1] == 1  # half-open, in a new window


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"repo": "r", "ts": i, "is_conflict": True}) for i in range(6)))
    p = spark.readStream.schema("repo string, ts long, is_conflict boolean").json(str(src))
    q = stateful.circuit_breaker(p).writeStream.format("memory").queryName("breaker").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("breaker").where("is_open").count() == 2
    f = tmp_path / "files"
    f.mkdir()
    for k, v in (("1", [("a", "1"), ("b", "2")]), ("2", [("a", "9"), ("c", "3")])):
        (f / f"{k}.json").write_text("\n".join(json.dumps({"path": a, "content": b}) for a, b in v))
        stream = spark.readStream.schema("path string, content string").json(str(f))
        stateful.change_feed(stream, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    got = {(r["path"], r["change"], r["batch"]) for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert got == {("a", "added", 0), ("b", "added", 0), ("a", "changed", 1), ("c", "added", 1)}
