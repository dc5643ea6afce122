"""A stored inverted index for lexical search.

Postings (token, chunk) are written once, in folders by a hash of the token, each folder's files sorted by token; a search reads the
folders of its tokens alone (partition pruning), and in them the row groups that hold the tokens (pushed filters). Postings of
one token are spread over several files, so that a frequent token is no single task's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.ids import tokens

BUCKETS, SPREAD = 64, 4


def _bucket(token, buckets: int):
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def write_index(chunks: DataFrame, path: str, buckets: int = BUCKETS, spread: int = SPREAD) -> None:
    """Writes the index of chunks (chunk_id, content; null contents have no tokens) below `path`, over one that is there."""
    every = chunks.select("chunk_id", F.explode(F.array_distinct(tokens(F.col("content")))).alias("token")).withColumn("bucket", _bucket(F.col("token"), buckets))
    dealt = every.repartition(buckets * spread, "bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(spread)))
    dealt.sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    chunks.select("chunk_id", F.coalesce("content", F.lit("")).alias("content")).write.mode("overwrite").parquet(f"{path}/chunks")


def postings(spark: SparkSession, path: str, words: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(token, chunk_id) of these tokens, from their folders alone."""
    rows = spark.createDataFrame([(w,) for w in sorted(set(words))], "token string")
    asked = [r[0] for r in rows.select(_bucket(F.col("token"), buckets)).distinct().collect()]  # a query's tokens
    kind = dict(spark.read.parquet(f"{path}/chunks").dtypes)["chunk_id"]
    return spark.read.schema(f"chunk_id {kind}, token string, bucket int").parquet(f"{path}/postings").where(F.col("bucket").isin(asked) & F.col("token").isin(sorted(set(words)))).select("token", "chunk_id")


def search_stored(spark: SparkSession, path: str, query: str, limit: int | None = 20, buckets: int = BUCKETS) -> DataFrame:
    """(rank, chunk_id, score, snippet): the share of the query's tokens (repeats count) that a chunk holds, the best first;
    of equal ones the one with the query's earlier token, then the smaller id. A query without tokens finds nothing."""
    words = spark.createDataFrame([(query,)], "q string").select(tokens(F.col("q"))).first()[0]
    if not words:
        return spark.createDataFrame([], "rank int, chunk_id string, score double, snippet string")
    asked = spark.createDataFrame(list(enumerate(words)), "pos int, token string")
    hits = postings(spark, path, words, buckets).join(F.broadcast(asked), "token").groupBy("chunk_id").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    best = hits.orderBy(F.desc("n"), "pos", "chunk_id")
    best = best.limit(limit) if limit is not None else best
    found = best.join(spark.read.parquet(f"{path}/chunks"), "chunk_id")
    if limit is not None:  # `limit` rows
        found = found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "pos", "chunk_id")))
    else:
        found = found.withColumn("rank", F.lit(None).cast("int"))
    return found.select("rank", "chunk_id", (F.col("n") / F.lit(len(words))).alias("score"), F.substring("content", 1, 200).alias("snippet"))
