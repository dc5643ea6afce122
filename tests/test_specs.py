"""Indented documents as rows, and the graphs of specifications."""

import json
import random
import tracemalloc

import pytest

from skein.sources import specs
from skein.sources.outline import outline

TEXT = """# head
services:
  web:   # comment
    image: "nginx:1.2"   # c
    depends_on:
    - db
    - 'ca''che'
    ports: [80, "443:443"]
    environment: {A: 1, B: 'x, y'}
    command: |
      echo: no
        - nor this
      # text
    url: http://x.y/z#frag
  db:
    image:  postgres
    depends_on: []
list:
- - a
  - b
- c: 1
  d: 2
-
  e: 3
"""


def _files(spark, **files):
    return spark.createDataFrame([(k, v) for k, v in files.items()], "path string, content string")


def test_outline(spark):
    got = outline(_files(spark, a=TEXT, none=None, empty="", b="x:\r\n  y: 1\r\n---\nz: 2\n", c="- 1\n- k: v"))
    rows = [(r["path"], r["doc"], "/".join(r["trail"]), r["value"]) for r in got.orderBy("path", "line").collect() if r["value"] is not None]
    assert rows == [
        ("a", 0, "services/web/image", "nginx:1.2"), ("a", 0, "services/web/depends_on/#6.4", "db"), ("a", 0, "services/web/depends_on/#7.4", "ca'che"),
        ("a", 0, "services/web/ports/#0", "80"), ("a", 0, "services/web/ports/#1", "443:443"), ("a", 0, "services/web/environment/A", "1"),
        ("a", 0, "services/web/environment/B", "x, y"), ("a", 0, "services/web/command", "|"), ("a", 0, "services/web/url", "http://x.y/z#frag"),
        ("a", 0, "services/db/image", "postgres"), ("a", 0, "services/db/depends_on", "[]"), ("a", 0, "list/#19.0/#19.2", "a"), ("a", 0, "list/#19.0/#20.2", "b"),
        ("a", 0, "list/#21.0/c", "1"), ("a", 0, "list/#21.0/d", "2"), ("a", 0, "list/#23.0/e", "3"),
        ("b", 0, "x/y", "1"), ("b", 1, "z", "2"), ("c", 0, "#1.0", "1"), ("c", 0, "#2.0/k", "v"),
    ]
    assert outline(_files(spark, a=None)).count() == 0


def _brute(x, trail=()):
    if isinstance(x, dict):
        for k, v in x.items():
            yield from _brute(v, (*trail, k))
    elif isinstance(x, list):
        for i, v in enumerate(x):
            yield from _brute(v, (*trail, i))
    else:
        yield trail, x


def _write(x, indent, rng):
    """Nested maps and lists of strings as indented text, lists at either indent."""
    pad = " " * indent
    if isinstance(x, dict):
        return "".join(f"{pad}{k}: {v}\n" if isinstance(v, str) else f"{pad}{k}:\n" + _write(v, indent + (rng.choice([0, 2, 4]) if isinstance(v, list) else rng.choice([1, 2, 4])), rng) for k, v in x.items())
    out = ""
    for v in x:
        out += f"{pad}- {v}\n" if isinstance(v, str) else f"{pad}- " + _write(v, indent + 2, rng)[indent + 2 :]
    return out


def test_outline_of_random_documents(spark):
    import random

    rng = random.Random(5)

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            return f"v{rng.randrange(99)}"
        if rng.random() < 0.4:
            return [make(depth - 1) for _ in range(rng.randrange(1, 4))]
        return {f"k{i}": make(depth - 1) for i in range(rng.randrange(1, 4))}

    docs = {f"d{i}": {f"t{j}": make(4) for j in range(3)} for i in range(40)}
    rows = outline(_files(spark, **{k: _write(v, 0, rng) for k, v in docs.items()})).where("value is not null").orderBy("path", "line").collect()
    for name, doc in docs.items():
        mine, places = [], {}
        for r in (r for r in rows if r["path"] == name):
            trail = []
            for k in r["trail"]:
                if k.startswith("#"):
                    seen = places.setdefault((*trail,), [])
                    if k not in seen:
                        seen.append(k)
                    k = seen.index(k)
                trail.append(k)
            mine.append((tuple(trail), r["value"]))
        assert mine == list(_brute(doc)), name


COMPOSE = """services:
  web:
    image: nginx
    depends_on: [db]
  job:
    depends_on:
      db:
        condition: service_healthy
      cache: {condition: x}
  db:
    image: postgres
  cache:
"""
API = """openapi: 3.0.0
info:
  title: Shop
  version: "1.0"
paths:
  /orders/{id}:
    parameters:
      - name: id
    get:
      summary: One order
      operationId: getOrder
      tags: [a, b]
      responses:
        '200':
          content:
            application/json:
              schema:
                properties:
                  id: {type: string}
                  user_id_id: {type: string}
                  total: {type: number}
    post:
      requestBody:
        content:
          application/json:
            schema:
              properties:
                customer_id:
                  type: string
    delete: {}
    patch:
"""
TF = 'provider "aws" {\n}\nresource "aws_s3" "b" {\n  provider = aws.west\n}\ndata "aws_ami" "u" {\n}\n'
K8S = "kind: Deployment\nmetadata:\n  name: web\nspec:\n  template:\n    spec:\n      containers:\n        - name: c\n          image: nginx:1\n        - image: side\n"


def _json_of(text, spark):
    """The same API as JSON, made by hand."""
    body = {"properties": {"customer_id": {"type": "string"}}}
    one = {"properties": {"id": {"type": "string"}, "user_id_id": {"type": "string"}, "total": {"type": "number"}}}
    get = {"summary": "One order", "operationId": "getOrder", "tags": ["a", "b"], "responses": {"200": {"content": {"application/json": {"schema": one}}}}}
    paths = {"/orders/{id}": {"parameters": [{"name": "id"}], "get": get, "post": {"requestBody": {"content": {"application/json": {"schema": body}}}}, "delete": {}, "patch": None}}
    return json.dumps({"openapi": "3.0.0", "info": {"title": "Shop", "version": "1.0"}, "paths": paths})


@pytest.mark.parametrize("form", ["yaml", "json"])
def test_api(spark, form):
    path = f"x/openapi.{form}"
    nodes, edges = specs.all_specs(_files(spark, **{path: API if form == "yaml" else _json_of(API, spark)}))
    got = {r["id"]: r for r in nodes.collect()}
    assert set(got) == {f"contract:{path}", f"doc:{path}", "api:GET:/orders/{id}", "api:POST:/orders/{id}", "api:DELETE:/orders/{id}"}
    assert got[f"contract:{path}"]["name"] == "Shop" and got[f"contract:{path}"]["metadata"] == {"version": "1.0", "format": "openapi"}
    assert got["api:GET:/orders/{id}"]["signature"] == "One order" and got["api:GET:/orders/{id}"]["metadata"] == {"operationId": "getOrder", "tags": "a,b", "responses": "200"}
    assert got["api:POST:/orders/{id}"]["signature"] == "POST /orders/{id}"
    ends = sorted((r["type"], r["src"], r["dst"], r["confidence"], r["evidence"][0]["snippet"]) for r in edges.collect())
    assert ends == sorted(
        [("DOCUMENTS", f"contract:{path}", f"api:{m}:/orders/{{id}}", 1.0, f"{m} /orders/{{id}}") for m in ("GET", "POST", "DELETE")]
        + [("CONSUMES", "api:POST:/orders/{id}", "table:customer", 0.7, "requestBody.customer_id"), ("READS", "api:GET:/orders/{id}", "table:id", 0.6, "response.200.id"), ("READS", "api:GET:/orders/{id}", "table:user_id", 0.6, "response.200.user_id_id")]
    )


def test_infrastructure(spark):
    files = {
        "a/docker-compose.yml": COMPOSE, "compose.yaml": json.dumps({"services": {"solo": {"image": "i", "depends_on": ["web"]}}}), "k8s/web.yml": K8S, "k8s/two.yaml": "kind: A\n---\nkind: B\n",
        "k8s/none.yaml": "a: 1\n", "web.yaml": K8S, "helm/x/Chart.yaml": "name: shop\nversion: 0.1.0\n", "m/main.tf": TF, "m/vars.tfvars": "a = 1\n", "k8s/broken.yaml": "{not json}", "compose.yml": None,
        "s.proto": "package p.q;\nservice Shop {\n  rpc Get(In) returns (Out) {}\n}\nmessage In {\n  string a = 1;\n  string b = 2;\n}\nmessage Out {\n  string a = 1;\n}\n",
    }
    nodes, edges = specs.all_specs(_files(spark, **files))
    got = {(r["id"], r["kind"], r["name"]) for r in nodes.collect()}
    assert got == {
        ("infra:a/docker-compose.yml", "Infra", "docker-compose.yml"), ("svc:web", "Service", "web"), ("svc:job", "Service", "job"), ("svc:db", "Service", "db"), ("svc:cache", "Service", "cache"),
        ("ext:nginx", "External", "nginx"), ("ext:postgres", "External", "postgres"), ("infra:compose.yaml", "Infra", "compose.yaml"), ("svc:solo", "Service", "solo"), ("ext:i", "External", "i"),
        ("infra:k8s/web.yml", "Infra", "Deployment/web"), ("ext:nginx:1", "External", "nginx:1"), ("ext:side", "External", "side"), ("infra:helm/x/Chart.yaml", "Infra", "helm:shop"),
        ("infra:m/main.tf", "Infra", "main"), ("infra:m/main.tf:aws_s3.b", "Infra", "aws_s3.b"), ("infra:m/main.tf:data.aws_ami.u", "Infra", "data.aws_ami.u"), ("infra:m/vars.tfvars", "Infra", "vars"),
        ("svc:p.q.Shop", "Service", "Shop"), ("fn:s.proto:Get", "Method", "Get"), ("table:In", "Table", "In"),
    }
    ends = {(r["type"], r["src"], r["dst"], r["confidence"]) for r in edges.collect()}
    a, m = "infra:a/docker-compose.yml", "infra:m/main.tf"
    assert ends == {("CONTAINS", a, f"svc:{s}", 1.0) for s in ("web", "job", "db", "cache")} | {
        ("DEPENDS_ON", "svc:web", "svc:db", 1.0), ("DEPENDS_ON", "svc:job", "svc:db", 1.0), ("DEPENDS_ON", "svc:job", "svc:cache", 1.0), ("DEPENDS_ON", "svc:web", "ext:nginx", 1.0), ("DEPENDS_ON", "svc:db", "ext:postgres", 1.0),
        ("CONTAINS", "infra:compose.yaml", "svc:solo", 1.0), ("DEPENDS_ON", "svc:solo", "svc:web", 1.0), ("DEPENDS_ON", "svc:solo", "ext:i", 1.0),
        ("DEPENDS_ON", "infra:k8s/web.yml", "ext:nginx:1", 1.0), ("DEPENDS_ON", "infra:k8s/web.yml", "ext:side", 1.0),
        ("CONTAINS", m, m + ":aws_s3.b", 1.0), ("DEPENDS_ON", m + ":aws_s3.b", "ext:aws", 0.9), ("CONTAINS", "svc:p.q.Shop", "fn:s.proto:Get", 1.0),
    }


SEED = """services:
  - id: shop
    paths: [src/shop, src/x]
  - id: svc:pay
externals:
  - id: stripe
    consumes:
      - post /v1/charge
      - api:GET:/x
pins:
  - {type: CALLS, from: svc:shop, to: svc:pay}
  - type: DEPENDS_ON
    from: svc:pay
    to: ext:stripe
    evidence: "told: by hand"
  - type: CALLS
    from: svc:shop
critical: [shop, nowhere]
"""


def test_seed(spark):
    nodes, edges, critical = specs.seed_graph(specs.entries(_files(spark, **{"seed.yaml": SEED})))
    assert {(r["id"], r["kind"], r["name"], r["path"], tuple(r["tags"])) for r in nodes.collect()} == {("svc:shop", "Service", "shop", "src/shop", ("seed",)), ("svc:pay", "Service", "pay", None, ("seed",)), ("ext:stripe", "External", "stripe", None, ("seed",))}
    assert {(r["type"], r["src"], r["dst"], r["evidence"][0]["snippet"]) for r in edges.collect()} == {
        ("CONSUMES", "ext:stripe", "api:POST:/v1/charge", "stripe consumes post /v1/charge"), ("CONSUMES", "ext:stripe", "api:GET:/x", "stripe consumes api:GET:/x"),
        ("CALLS", "svc:shop", "svc:pay", "seed pin"), ("DEPENDS_ON", "svc:pay", "ext:stripe", "told: by hand"),
    }
    assert {r["id"] for r in critical.collect()} == {"shop", "nowhere"}
    assert [r["id"] for r in specs.resolve_critical(nodes, critical).collect()] == ["svc:shop"]


def test_json_entries_are_read_bit_by_bit(spark):
    """Entries are those of the parsed text, whatever its keys repeat and wherever it breaks; no text's values are all held at once."""

    def held(text):
        try:
            stack = [((), json.loads(text))]
        except ValueError:
            return []
        out = []
        while stack:
            trail, x = stack.pop()
            if isinstance(x, dict | list) and x:
                stack += [((*trail, k), v) for k, v in (x.items() if isinstance(x, dict) else ((f"#{i}", v) for i, v in enumerate(x)))]
                out.append((list(trail), None))
            else:
                out.append((list(trail), None if x is None or x == "" else x if isinstance(x, str) else json.dumps(x)))
        return [o for o in out if o[0]]

    rng = random.Random(6)

    def value(d):
        r = rng.random()
        if d > 4 or r < 0.3:
            return rng.choice(["1", "2.50", "null", "true", '"x"', '""', "{}", "[]", '"\\n"'])
        if r < 0.8:
            return "{" + " , ".join(f'"{rng.choice("abcd")}" :{value(d + 1)}' for _ in range(rng.randint(1, 4))) + "}"
        return "[" + ",".join(value(d + 1) for _ in range(rng.randint(1, 3))) + " ]"

    for _ in range(3000):
        text = value(0)
        k = rng.randrange(len(text))
        for t in (text, text[:k] + rng.choice('{}[],:" x') + text[k + 1 :]):
            assert sorted(map(repr, specs.json_entries(t))) == sorted(map(repr, held(t)))
    big = '{"paths":{' + ",".join(f'"/p{i}":{{"get":{{"tags":["a"],"x":{{"y":{i}}}}}}}' for i in range(60_000)) + "}}"
    tracemalloc.start()
    n = sum(1 for _ in specs.json_entries(big))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1 + 60_000 * 6 and peak < 25 * len(big) // 3
