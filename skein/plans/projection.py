"""The driver's relational tables as a property graph, in Spark and in SQL.

This is a harness: the engine itself knows nodes and edges alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.ids import edge_id
from skein.operators.loops import release, settle

NODES_SQL = """
select 'repo:R' || r_regionkey as id, 'Repo' as kind, r_name as name, cast(null as varchar) as path, false as critical from region
union all select 'svc:N' || n_nationkey, 'Service', n_name, null, false from nation
union all select 'fn:customer/N' || c_nationkey || ':C' || c_custkey, 'Function', c_name, 'customer/N' || c_nationkey, c_custkey % 7 = 0 from customer
union all select 'fn:orders/' || o_orderstatus || ':O' || o_orderkey, 'Function', 'O' || o_orderkey, 'orders/' || o_orderstatus, false from orders
union all select 'table:P' || p_partkey, 'Table', p_name, null, p_size = 50 from part
union all select 'ext:S' || s_suppkey, 'External', s_name, null, false from supplier
union all select distinct 'api:POST:/' || lower(c_mktsegment), 'API', lower(c_mktsegment), '/' || lower(c_mktsegment), false from customer
union all select distinct 'event:' || event_type, 'Event', event_type, null, false from events
union all select distinct 'test:conv:T' || conv_id, 'Test', 'T' || conv_id, null, false from conversations
union all select 'doc:' || doc_id, 'Doc', 'D' || doc_id, 'docs/' || source, false from documents
union all select 'cls:benchmark:I' || item_id, 'Class', 'I' || item_id, null, false from benchmark
"""
_CUST = "'fn:customer/N' || c_nationkey || ':C' || c_custkey"
_ORDER = "'fn:orders/' || o_orderstatus || ':O' || o_orderkey"
ENDS_SQL = f"""
select 'CALLS' as type, {_CUST} as src, {_ORDER} as dst from customer join orders on o_custkey = c_custkey
union all select 'CALLS', src, dst from chain where dst is not null
union all select 'CALLS', src, first_id from chain where dst is null and n >= 2 and o_custkey % 10 = 0
union all select distinct 'WRITES', {_ORDER}, 'table:P' || l_partkey from lineitem join orders on l_orderkey = o_orderkey
union all select distinct 'CALLS', {_ORDER}, 'ext:S' || l_suppkey from lineitem join orders on l_orderkey = o_orderkey
union all select 'EXPOSES', {_CUST}, 'api:POST:/' || lower(c_mktsegment) from customer where c_acctbal > 0
union all select distinct 'CONSUMES', 'svc:N' || c_nationkey, 'api:POST:/' || lower(c_mktsegment) from customer
union all select distinct 'PUBLISHES', {_CUST}, 'event:' || event_type from events join customer on user_id = c_custkey where event_id % 2 = 0
union all select distinct 'SUBSCRIBES', {_CUST}, 'event:' || event_type from events join customer on user_id = c_custkey where event_id % 2 = 1
union all select distinct 'TESTS', 'test:conv:T' || conv_id, {_CUST} from conversations join customer on conv_id = c_custkey
union all select 'CONTAINS', 'repo:R' || n_regionkey, 'svc:N' || n_nationkey from nation
union all select 'CONTAINS', 'svc:N' || c_nationkey, {_CUST} from customer
union all select 'DEPENDS_ON', 'svc:N' || n_nationkey, 'repo:R' || n_regionkey from nation
"""
CHAIN_SQL = f"""
select o_custkey, {_ORDER} as src,
  lead({_ORDER}) over (partition by o_custkey order by o_orderdate, o_orderkey) as dst,
  first_value({_ORDER}) over (partition by o_custkey order by o_orderdate, o_orderkey) as first_id,
  count(*) over (partition by o_custkey) as n
from orders join (select c_custkey from customer) c on o_custkey = c_custkey
"""
#: What oracle queries begin with: nodes, edges (no ids), chain.
WITH = f"""with recursive nodes as ({NODES_SQL}), chain as ({CHAIN_SQL}), edges as ({ENDS_SQL})"""

_made: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def relations(spark: SparkSession, sf_dir: str) -> None:
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "conversations"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"sk_{t}")


def _sql(text: str) -> str:
    import re

    text = re.sub(r"\b(from|join) (region|nation|customer|supplier|part|orders|lineitem|events|documents|benchmark|conversations)\b", r"\1 sk_\2", text)
    return text.replace("varchar", "string")


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as written tables, built once for each input and application."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _made:
        relations(spark, sf_dir)
        nodes = spark.sql(_sql(NODES_SQL)).withColumn("tags", F.when(F.col("critical"), F.array(F.lit("critical"))).otherwise(F.array().cast("array<string>"))).drop("critical")
        ends = spark.sql(f"with chain as ({_sql(CHAIN_SQL)}) {_sql(ENDS_SQL)}")
        edges = ends.select(edge_id(F.col("src"), F.col("dst"), F.col("type")).alias("id"), "type", "src", "dst")
        _made[at] = settle(nodes), settle(edges)
        del nodes, ends, edges
        release(spark)  # what building the graph has shuffled
    return _made[at]


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw WRITES edges, one for each line of an order, in arrival order (seq; rows of equal seq are equal), with evidence; some conflict."""
    relations(spark, sf_dir)
    d = spark.sql(_sql(f"select l_orderkey, l_linenumber, l_returnflag, l_quantity, {_ORDER} as src, 'table:P' || (l_partkey % 50) as dst from lineitem join orders on l_orderkey = o_orderkey"))
    return d.select(
        edge_id(F.lit("table:L"), F.col("dst"), F.lit("WRITES")).alias("id"), F.lit("WRITES").alias("type"), F.lit("table:L").alias("src"), "dst",
        F.array(F.struct(F.lit("lineitem").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("snippet"))).alias("evidence"),
        F.array(F.concat(F.lit("s"), F.col("l_returnflag"))).alias("sources"), (F.col("l_quantity") / 100).alias("confidence"),
        (F.col("l_orderkey") % 97 == 0).alias("conflict"), F.struct("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity").alias("seq"),
    )


__all__ = ["WITH", "graph", "occurrences", "relations"]
