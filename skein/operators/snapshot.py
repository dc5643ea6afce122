"""Replacing a stored graph (K5, K7), and written snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import analytics as A
from skein.operators.loops import drop_settled, release, settle
from skein.operators.mining import manifest_diff
from skein.operators.store import dangling, ends, page
from skein.operators.traverse import impact

Graph = tuple[DataFrame, DataFrame]
# Kinds whose first names a snapshot lists.
LISTED = ("Service", "Table", "API", "External", "Test", "Infra")


def replace(path: str, nodes: DataFrame, edges: DataFrame, over: int | None = None) -> Graph:
    """The graph in the folder `path` becomes these tables, which may read what it holds: they are written beside it first.

    Each table is replaced by Spark's own overwrite, the version (one more than before) last; what fails while it is being
    made leaves the folder as it was. With over, it fails if that is not the folder's version any more."""
    spark = nodes.sparkSession
    _check(spark, path, over)
    nodes, edges = settle(nodes), settle(edges)
    before = _check(spark, path, over)
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    spark.range(before + 1, before + 2).toDF("version").write.mode("overwrite").json(f"{path}/version")
    drop_settled(nodes, edges)
    return read(spark, path)


def _check(spark: SparkSession, path: str, over: int | None) -> int:
    at = version(spark, path)
    if over is not None and over != at:
        raise RuntimeError(f"version {over} is not the current one any more")
    return at


def version(spark: SparkSession, path: str) -> int:
    """How many times the folder's graph was replaced; 0 where there is none."""
    held = read_json(spark, f"{path}/version", "version long")
    row = held.agg(F.max("version")).first() if held is not None else None
    return row[0] if row and row[0] is not None else 0


def read(spark: SparkSession, path: str) -> Graph:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def transaction(spark: SparkSession, path: str, work: Callable[[Graph], Graph]) -> Graph:
    """The folder's graph becomes what work makes of it; an error in work, or another replacement meanwhile, leaves it as it was."""
    at = version(spark, path)
    return replace(path, *work(read(spark, path)), over=at)


def update_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """old (path, hash, size) brought to new: files that are gone go, changed and added ones come from new, others stay."""
    change = manifest_diff(old, new)
    kept = old.join(change.select("path"), "path", "left_anti")
    return kept.unionByName(new.join(change.where("change <> 'removed'").select("path"), "path", "left_semi").select(*old.columns))


def context(nodes: DataFrame, edges: DataFrame, focus: str | None = None, cycle_length: int | None = None, listed: int = 100) -> DataFrame:
    """(section, item, n): sizes, nodes by kind, edges by type, languages, first names by kind, the height view, insights
    with their scores, health, policies, verification (1 if passed), and what the node `focus` reaches by kind.

    The parts are written one after another, and what each has shuffled goes before the next; degrees, ends and dangling edges,
    which several read, are made once."""
    spark = nodes.sparkSession
    row = lambda df, section, item, n: df.select(F.lit(section).alias("section"), item.cast("string").alias("item"), n.cast("long").alias("n"))
    count = lambda df, section, item: row(df.agg(F.count("*").alias("n")), section, F.lit(item), F.col("n"))
    by = lambda df, section, key: row(df.groupBy(key).agg(F.count("*").alias("n")), section, F.col(key), F.col("n"))
    parts = [count(nodes, "summary", "nodes"), count(edges, "summary", "edges"), by(nodes, "kinds", "kind"), by(edges, "types", "type")]
    if "lang" in nodes.columns:
        parts.append(row(nodes.where("lang is not null").select("lang").distinct(), "languages", F.col("lang"), F.lit(1)))

    def written(df):
        out = settle(df)
        release(spark)
        return out

    for kind in LISTED:
        parts.append(row(page(nodes, kind, limit=listed), kind, F.col("name"), F.lit(1)))
    n, e = A.view(nodes, edges, "height", None)
    parts += [count(n, "height", "nodes"), count(e, "height", "edges")]
    done = [written(_all(parts))]
    scored, parts = written(A.scored(nodes, edges)), []
    for name, found in (("highly_coupled", A.highly_coupled(scored)), ("bottlenecks", A.bottlenecks(scored)), ("hubs", A.hubs(scored)), ("isolated", A.isolated(scored)), ("hotspots", A.hotspots(A.downstream_of_top(nodes, edges, s=scored)))):
        parts.append(row(found, name, F.col("name"), F.col("score")))
    done.append(written(_all(parts)))
    drop_settled(scored)
    if cycle_length is not None:
        done.append(written(count(A.cycles(edges, cycle_length), "insights", "cycles")))
    met = written(ends(edges))
    bad = written(dangling(nodes, edges, met))
    h = A.health(nodes, edges, met, bad)
    done.append(written(row(h, "health", F.concat_ws("/", "category", "item"), F.col("n"))))
    drop_settled(met)
    done.append(written(by(A.policies(nodes, edges), "policies", "policy")))
    done.append(written(row(A.verify(nodes, edges, bad=bad), "verification", F.col("name"), F.col("passed").cast("int"))))
    if focus is not None:
        start = nodes.where(F.col("id") == focus).select(F.col("id").alias("source"), "id")
        done.append(written(by(impact(nodes, edges, start).where("depth > 0"), "focus", "kind")))
    return _all(done)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def save_json(rows: DataFrame, path: str) -> None:
    """A snapshot, manifest or state as JSON lines; what was there is replaced."""
    rows.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """What save_json() wrote; None where nothing is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        return None
    return spark.read.schema(schema).json(path)
