"""Specifications, YAML or JSON, as nodes and edges: APIs, protobuf, Compose, Terraform, Kubernetes, Helm, seeds."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import islice
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.ids import basename, edge_id
from skein.operators.loops import settle
from skein.operators.store import resolve
from skein.sources.manifests import messages, protobuf, terraform
from skein.sources.outline import outline

# Which paths hold which specification, and the methods of an API.
COMPOSE = r"(?i)(^|/)(docker-)?compose\.ya?ml$"
KUBERNETES = r"(?i)(k8s|kubernetes|helm|deploy)/.*\.ya?ml$"
HELM = r"(?i)helm.*/chart\.yaml$"
API = r"(?i)(openapi|swagger|api-spec|asyncapi).*\.(ya?ml|json)$"
METHODS = ("get", "post", "put", "delete", "patch", "options", "head")
TERRAFORM = r"(?i)\.(tf|tfvars)$"

NODE = "id string, kind string, name string, path string, signature string, metadata map<string,string>"


_BLANK = re.compile(r"[ \t\n\r]*")
_DECODER = json.JSONDecoder()
#: Levels of a JSON text that are read entry by entry, and entries that are handed on at once. Fixed values.
LEVELS, AT_ONCE = 2, 4096


def _below(trail: tuple, top) -> Iterator[tuple]:
    """Every entry of a value as its trail and value, the value itself first."""
    stack = [(trail, top)]
    while stack:
        trail, x = stack.pop()
        if isinstance(x, dict | list) and x:
            yield trail, None
            pairs = x.items() if isinstance(x, dict) else ((f"#{i}", v) for i, v in enumerate(x))
            stack += [((*trail, str(k)), v) for k, v in pairs]
        else:
            yield trail, None if x is None or x == "" else x if isinstance(x, str) else json.dumps(x)


def _read(text: str, at: int, trail: tuple, last: dict, tell: bool | None) -> Iterator[tuple]:
    """The entries of the value at a place, where tell; returns the place behind it. last: where a key's value begins that counts,
    filled in where tell is None."""
    skip = lambda i: _BLANK.match(text, i).end()
    inner = skip(at + 1)
    if len(trail) >= LEVELS or text[at : at + 1] != "{" or text[inner : inner + 1] == "}":
        value, end = _DECODER.raw_decode(text, at)
        if tell:
            yield from _below(trail, value)
        return end
    if tell:
        yield trail, None
    while True:
        if text[inner : inner + 1] != '"':
            raise ValueError("a key is missing")
        key, at = scanstring(text, inner + 1, True)
        at = skip(at)
        if text[at : at + 1] != ":":
            raise ValueError("a colon is missing")
        at, own = skip(at + 1), (*trail, key)
        now = tell and last[own] == at
        if tell is None:
            last[own] = at
        at = skip((yield from _read(text, at, own, last, now)))
        if text[at : at + 1] == "}":
            return at + 1
        if text[at : at + 1] != ",":
            raise ValueError("a comma is missing")
        inner = skip(at + 1)


def json_entries(text: str) -> Iterator[tuple]:
    """Every entry of a JSON object as its trail and value; none of a text that is no JSON.

    The text is read twice, first to see that it is whole and which of equal keys counts (the last); a value on the third
    level is held at a time, not all of the text's values."""
    last: dict = {}

    def whole():
        end = yield from _read(text, _BLANK.match(text).end(), (), last, None)
        if _BLANK.match(text, end).end() < len(text):
            raise ValueError("more than one value")

    try:
        for _ in whole():
            pass
    except (ValueError, RecursionError):
        return
    yield from ((list(t), v) for t, v in _read(text, _BLANK.match(text).end(), (), last, True) if t)


def _entry_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("path", pa.string()), ("trail", pa.list_(pa.string())), ("value", pa.string())])
    for b in batches:
        for path, text in zip(b.column(0), b.column(1)):
            rows = json_entries(text.as_py())
            while some := list(islice(rows, AT_ONCE)):
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(some), pa.string()), pa.array([t for t, _ in some], pa.list_(pa.string())), pa.array([v for _, v in some], pa.string())], schema=kind)


def entries(files: DataFrame) -> DataFrame:
    """(path, line, trail, value) of YAML and JSON documents. A file of several documents has no rows; JSON has no lines (0)."""
    f = files.where("content is not null")
    is_json = F.rlike("content", F.lit(r"^\s*\{")) & F.rlike("content", F.lit(r"\}\s*$"))
    j = f.where(is_json).select("path", "content").mapInArrow(_entry_batches, "path string, trail array<string>, value string").select("path", F.lit(0).alias("line"), "trail", "value")
    y = settle(outline(f.where(~is_json)))
    many = y.groupBy("path").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b")
    return j.unionByName(y.join(many, "path", "left_anti").select("path", "line", "trail", "value"))


def _node(id_: Column, kind: str, name: Column, signature: Column | None = None, /, **meta: Column) -> list[Column]:
    held = F.create_map(*(x for k, v in meta.items() for x in (F.lit(k), v.cast("string")))) if meta else F.create_map().cast("map<string,string>")
    held = F.map_filter(held, lambda _, v: v.isNotNull())
    return [id_.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), "path", (signature if signature is not None else F.lit(None).cast("string")).alias("signature"), held.alias("metadata")]


def _edge(src: Column, kind: str, dst: Column, snippet: Column, by: str, confidence: float = 1.0) -> list[Column]:
    note = F.array(F.struct(F.col("path").alias("file"), F.lit(1).alias("line"), snippet.alias("snippet")))
    return [edge_id(src, dst, F.lit(kind)).alias("id"), F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"), note.alias("evidence"), F.array(F.lit(by)).alias("sources"), F.lit(confidence).alias("confidence"), F.lit(False).alias("conflict")]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _t(i: int) -> Column:
    return F.get("trail", F.lit(i))


def _pre(*names: str | None) -> Column:
    """The trail is as long as names and has them where they are given."""
    ok = F.size("trail") == len(names)
    for i, n in enumerate(names):
        ok = ok & (_t(i) == n) if n is not None else ok
    return ok


def _external(d: DataFrame, name: Column) -> DataFrame:
    return d.withColumn("path", F.lit(None).cast("string")).select(*_node(F.concat(F.lit("ext:"), name), "External", name))


def compose_graph(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of entries: the file as Infra, its services, CONTAINS and DEPENDS_ON edges to services and images."""
    file = F.concat(F.lit("infra:"), "path")
    service = F.concat(F.lit("svc:"), _t(1))
    image = e.where(_pre("services", None, "image") & F.col("value").isNotNull())
    of_image = F.max(F.when((F.size("trail") == 3) & (_t(2) == "image"), F.col("value"))).alias("image")
    one = e.where((_t(0) == "services") & _t(1).isNotNull()).groupBy("path", _t(1).alias("service")).agg(of_image)
    own = F.concat(F.lit("svc:"), "service")
    named = F.when(F.startswith(_t(3), F.lit("#")), F.col("value")).otherwise(_t(3))
    needs = e.where(_pre("services", None, "depends_on", None)).withColumn("_on", named).where("_on is not null")
    nodes = [
        e.where(_pre("services")).select(*_node(file, "Infra", basename(F.col("path")), type=F.lit("docker-compose"))),
        one.select(*_node(own, "Service", F.col("service"), image=F.col("image"))),
        _external(image, F.col("value")),
    ]
    edges = [
        one.select(*_edge(file, "CONTAINS", own, F.concat(F.lit("service: "), "service"), "infra")),
        needs.select(*_edge(service, "DEPENDS_ON", F.concat(F.lit("svc:"), "_on"), F.concat(F.lit("depends_on: "), "_on"), "infra")),
        image.select(*_edge(service, "DEPENDS_ON", F.concat(F.lit("ext:"), "value"), F.concat(F.lit("image: "), "value"), "infra")),
    ]
    return _union(nodes), _union(edges)


def _of(e: DataFrame, *trail: str) -> DataFrame:
    """(path, the value of one entry) under the name of the trail's last key."""
    return e.where(_pre(*trail)).groupBy("path").agg(F.max("value").alias("_".join(trail)))


def kubernetes_graph(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of entries: each file with a kind as Infra, DEPENDS_ON edges to the images of its containers.

    The containers are those of spec, or of the template in it where spec has none of its own."""
    kind = _of(e, "kind").where("kind is not null")
    name = kind.join(_of(e, "metadata", "name"), "path", "left").join(_of(e, "metadata", "namespace"), "path", "left")
    file = F.concat(F.lit("infra:"), "path")
    shown = F.concat_ws("/", "kind", F.coalesce("metadata_name", basename(F.col("path"))))
    nodes = name.select(*_node(file, "Infra", shown, type=F.lit("kubernetes"), kind=F.col("kind"), name=F.col("metadata_name"), namespace=F.col("metadata_namespace")))
    own = e.where(_pre("spec", "containers"))
    direct = e.where(_pre("spec", "containers", None, "image"))
    below = e.where(_pre("spec", "template", "spec", "containers", None, "image")).join(own.select("path"), "path", "left_anti")
    images = direct.unionByName(below).where("value is not null").join(kind.select("path"), "path", "left_semi")
    edges = images.select(*_edge(file, "DEPENDS_ON", F.concat(F.lit("ext:"), "value"), F.concat(F.lit("image: "), "value"), "infra"))
    return nodes.unionByName(_external(images, F.col("value"))), edges


def helm_graph(e: DataFrame) -> DataFrame:
    """Of entries: each chart with a name as Infra."""
    d = _of(e, "name").where("name is not null").join(_of(e, "version"), "path", "left")
    return d.select(*_node(F.concat(F.lit("infra:"), "path"), "Infra", F.concat(F.lit("helm:"), "name"), type=F.lit("helm_chart"), version=F.col("version")))


def api_graph(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of entries: each specification with paths as Contract and Doc, its operations as API nodes, DOCUMENTS edges to them.

    A property of a body or a response whose name is id or ends in _id is an edge (CONSUMES, READS) to the table that it names."""
    spec = e.where(_pre("paths")).select("path").distinct()
    for trail in (("info", "title"), ("info", "version"), ("info", "description"), ("openapi",)):
        spec = spec.join(_of(e, *trail), "path", "left")
    title = F.coalesce("info_title", "path")
    shape = F.when(F.col("openapi").isNotNull(), "openapi").otherwise("swagger")
    contract = F.concat(F.lit("contract:"), "path")
    is_op = (_t(0) == "paths") & F.lower(_t(2)).isin(*METHODS)
    ops = settle(e.where(is_op & ((F.size("trail") > 3) | (F.col("value") == "{}"))).withColumn("_last", F.element_at("trail", -1)))
    flat = F.size("trail") == 4
    pick = lambda k: F.max(F.when(flat & (F.col("_last") == k), F.col("value")))
    tags = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.size("trail") == 5) & (_t(3) == "tags") & F.col("value").isNotNull(), F.struct("line", _t(4).alias("k"), "value")))), lambda x: x["value"]), ",")
    codes = F.array_join(F.array_sort(F.collect_set(F.when((F.size("trail") >= 5) & (_t(3) == "responses"), _t(4)))), ",")
    one = ops.groupBy("path", _t(1).alias("route"), F.upper(_t(2)).alias("method")).agg(pick("summary").alias("summary"), pick("operationId").alias("operation"), tags.alias("tags"), codes.alias("codes"))
    name, id_ = F.concat_ws(" ", "method", "route"), F.concat_ws(":", F.lit("api"), "method", "route")
    nodes = [
        spec.select(*_node(contract, "Contract", title, version=F.col("info_version"), description=F.col("info_description"), format=shape)),
        spec.select(*_node(F.concat(F.lit("doc:"), "path"), "Doc", title)),
        one.select(*_node(id_, "API", name, F.coalesce("summary", name), operationId=F.col("operation"), tags=F.nullif("tags", F.lit("")), responses=F.nullif("codes", F.lit("")))),
    ]
    edges = [one.select(*_edge(contract, "DOCUMENTS", id_, name, "openapi"))]
    own = F.concat_ws(":", F.lit("api"), F.upper(_t(2)), _t(1))
    table = F.concat(F.lit("table:"), F.regexp_replace("_last", r"^(.*?)_id", "$1"))
    refers = (F.col("_last") == "id") | F.endswith("_last", F.lit("_id"))
    asks = ops.where((F.size("trail") == 9) & (_t(3) == "requestBody") & (_t(4) == "content") & (_t(6) == "schema") & (_t(7) == "properties") & refers)
    gives = ops.where((F.size("trail") == 10) & (_t(3) == "responses") & (_t(5) == "content") & (_t(7) == "schema") & (_t(8) == "properties") & refers)
    edges.append(asks.select(*_edge(own, "CONSUMES", table, F.concat(F.lit("requestBody."), "_last"), "openapi", 0.7)))
    edges.append(gives.select(*_edge(own, "READS", table, F.concat(F.lit("response."), _t(4), F.lit("."), F.col("_last")), "openapi", 0.6)))
    return _union(nodes), _union(edges)


def protobuf_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Services with their calls (CONTAINS), messages with two fields or more as tables."""
    package = files.where("content is not null").select("path", F.coalesce(F.nullif(F.regexp_extract("content", r"(?m)^package\s+([\w.]+);", 1), F.lit("")), F.col("path")).alias("package"))
    calls = protobuf(files).join(package, "path")
    every = files.where(F.endswith("path", F.lit(".proto"))).select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^service\s+(\w+)\s*\{"), 1)).alias("service")).join(package, "path")
    service, call = F.concat(F.lit("svc:"), "package", F.lit("."), "service"), F.concat(F.lit("fn:"), "path", F.lit(":"), "rpc")
    told = F.concat(F.lit("rpc "), "rpc", F.lit("("), "request", F.lit(") returns ("), "response", F.lit(")"))
    nodes = [
        every.select(*_node(service, "Service", F.col("service"), package=F.col("package"), type=F.lit("protobuf"))),
        calls.select(*_node(call, "Method", F.col("rpc"), told)),
        messages(files).select(*_node(F.concat(F.lit("table:"), "message"), "Table", F.col("message"), type=F.lit("protobuf_message"), fields=F.col("fields"))),
    ]
    return _union(nodes), calls.select(*_edge(service, "CONTAINS", call, F.concat(F.lit("rpc "), "rpc"), "parser"))


def terraform_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files, resources and data as Infra; a file CONTAINS its resources, each of them DEPENDS_ON every provider that its file names."""
    f = files.where(F.rlike("path", F.lit(TERRAFORM)) & F.col("content").isNotNull())
    file, name = F.concat(F.lit("infra:"), "path"), F.concat_ws(".", "type", "name")
    blocks = terraform(f.withColumn("path", F.concat("path", F.lit(".tf")))).withColumn("path", F.regexp_replace("path", r"\.tf$", "")).where("type is not null")
    made, read = blocks.where("block = 'resource'"), blocks.where("block = 'data'")
    own, seen = F.concat(file, F.lit(":"), name), F.concat(file, F.lit(":data."), name)
    nodes = [
        f.select(*_node(file, "Infra", F.regexp_replace(basename(F.col("path")), r"\.[^.]*$", ""), type=F.lit("terraform"))),
        made.select(*_node(own, "Infra", name, type=F.lit("terraform_resource"), resourceType=F.col("type"), resourceName=F.col("name"))),
        read.select(*_node(seen, "Infra", F.concat(F.lit("data."), name), type=F.lit("terraform_data"))),
    ]
    providers = f.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r'provider\s*=\s*"?(\w+)"?'), 1))).alias("provider"))
    edges = [
        made.select(*_edge(file, "CONTAINS", own, F.concat(F.lit('resource "'), "type", F.lit('" "'), "name", F.lit('"')), "infra")),
        made.join(providers, "path").select(*_edge(own, "DEPENDS_ON", F.concat(F.lit("ext:"), "provider"), F.concat(F.lit("provider = "), "provider"), "infra", 0.9)),
    ]
    return _union(nodes), _union(edges)


def all_specs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all specifications among files (path, content), by their paths. An id stands once for each file that tells of it."""
    some = files.where(F.rlike("path", F.lit("|".join((COMPOSE, KUBERNETES, HELM, API)))))
    e = settle(entries(some))
    on = lambda rx: e.where(F.rlike("path", F.lit(rx)))
    proto = files.where(F.endswith("path", F.lit(".proto")))
    made = [compose_graph(on(COMPOSE)), kubernetes_graph(on(KUBERNETES)), api_graph(on(API)), protobuf_graph(proto), terraform_graph(files)]
    return _union([n for n, _ in made] + [helm_graph(on(HELM))]), _union([d for _, d in made])


def route_id(route: Column) -> Column:
    """api:METHOD:/path of a method and a path; other texts stay."""
    rx = r"(?i)^(" + "|".join(METHODS) + r")\s+(/\S+)"
    return F.when(~F.startswith(route, F.lit("api:")) & F.rlike(route, F.lit(rx)), F.concat_ws(":", F.lit("api"), F.upper(F.regexp_extract(route, rx, 1)), F.regexp_extract(route, rx, 2))).otherwise(route)


def seed_graph(e: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, critical (id)) of a seed's entries: services, externals with what they consume, pins, ids to be marked critical.

    Pins without type, from or to are left out; ids without a prefix get that of their kind."""
    prefixed = lambda c, p: F.when(F.startswith(c, F.lit(p)), c).otherwise(F.concat(F.lit(p), c))
    bare = lambda c, p: F.regexp_replace(c, "^" + re.escape(p), "")
    item = e.where(_t(0).isin("services", "externals", "pins") & (F.size("trail") >= 3))
    pick = lambda k: F.max(F.when((F.size("trail") == 3) & (_t(2) == k), F.col("value")))
    first = F.min(F.when((F.size("trail") == 4) & (_t(2) == "paths") & F.col("value").isNotNull(), F.struct("line", _t(3).alias("k"), "value"))).alias("first")
    d = settle(item.groupBy("path", _t(0).alias("part"), _t(1).alias("item")).agg(pick("id").alias("id_"), pick("type").alias("type_"), pick("from").alias("from_"), pick("to").alias("to_"), pick("evidence").alias("note"), first))
    at = F.col("path")
    tag = F.array(F.lit("seed"))
    services, externals = d.where("part = 'services' and id_ is not null"), d.where("part = 'externals' and id_ is not null")
    nodes = services.withColumn("path", F.col("first.value")).select(*_node(prefixed(F.col("id_"), "svc:"), "Service", bare(F.col("id_"), "svc:")), tag.alias("tags"))
    nodes = nodes.unionByName(externals.withColumn("path", F.lit(None).cast("string")).select(*_node(prefixed(F.col("id_"), "ext:"), "External", bare(F.col("id_"), "ext:")), tag.alias("tags")))
    uses = e.where(_pre("externals", None, "consumes", None) & F.col("value").isNotNull()).select("path", _t(1).alias("item"), F.col("value").alias("route"))
    uses = uses.join(externals.select(at, "item", "id_"), ["path", "item"])
    edges = uses.select(*_edge(prefixed(F.col("id_"), "ext:"), "CONSUMES", route_id(F.col("route")), F.concat_ws(" ", "id_", F.lit("consumes"), "route"), "user"))
    pinned = d.where("part = 'pins' and type_ is not null and from_ is not null and to_ is not null").withColumnRenamed("from_", "_f").withColumnRenamed("to_", "_t")
    kind_edge = pinned.select(edge_id(F.col("_f"), F.col("_t"), F.col("type_")).alias("id"), F.col("type_").alias("type"), F.col("_f").alias("src"), F.col("_t").alias("dst"), F.array(F.struct(at.alias("file"), F.lit(1).alias("line"), F.coalesce("note", F.lit("seed pin")).alias("snippet"))).alias("evidence"), F.array(F.lit("user")).alias("sources"), F.lit(1.0).alias("confidence"), F.lit(False).alias("conflict"))
    critical = e.where(_pre("critical", None) & F.col("value").isNotNull()).select(F.col("value").alias("id")).distinct()
    return nodes, edges.unionByName(kind_edge), critical


def resolve_critical(nodes: DataFrame, critical: DataFrame) -> DataFrame:
    """(id) of the nodes that the texts listed resolve to; a seed lists a handful."""
    out = nodes.select("id").limit(0)
    for r in critical.collect():
        out = out.union(resolve(nodes, r["id"]).select("id"))
    return out.distinct()
