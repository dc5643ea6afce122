"""What the operators share: the shared folder, written tables, code for the executors, components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp()) / "skein_src.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(to))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local master gets one of its own; a cluster, whose
    executors would each write to their own disk, an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.gettempdir()}/skein-shared"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Write df under the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def discard(*stashed: DataFrame) -> None:
    """Delete what stash() wrote. Only for tables from which everything needed has been written since."""
    for df in stashed:
        if path := getattr(df, "_stashed_at", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner see which shuffles nothing refers to any more, so that their files go before a job's end."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add_columns(df: DataFrame, text: str, schema: str, maker) -> DataFrame:
    """df with the columns of schema, made from its text column by maker()(text), a function from a value to a tuple.

    maker is called once in each task. Columns named like a new one are replaced."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    made = df.sparkSession.createDataFrame([], schema).schema
    df = df.drop(*(n for n in made.names if n != text))
    kept = [f for f in df.schema.fields if f.name not in made.names]
    source = df.select(*(f.name for f in kept), *([F.col(text).alias(f"_in_{text}")] if text in made.names else []))
    at, types = source.columns.index(f"_in_{text}" if text in made.names else text), to_arrow_schema(made).types
    n_kept, names = len(kept), [*(f.name for f in kept), *made.names]

    def run(batches):
        of = maker()
        for batch in batches:
            rows = [of(t) for t in batch.column(at).to_pylist()]
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], *cols], names=names)

    return source.mapInArrow(run, StructType([*kept, *made.fields]))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (long ids): a row (id, component_id) for each end, written.

    component_id is the smallest id of the component. Each round gives every node that has smaller neighbours the
    smallest of them as its parent, and links the others to that one; when no such link is left, the parents are a
    forest, whose depth halves by each join with itself. Only aggregates of min() (combined before the shuffle) and
    joins on the node, never a node's neighbours in one place. Each round is written to the shared folder, and
    the one before deleted. Self-links give components of one. No edges: no rows.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    first = held = stash(ends.select("a", "b", F.lit(True).alias("more")).distinct())
    for _ in range(max_rounds):
        live = held.where("a <> b").select("a", "b")
        low = live.groupBy("a").agg(F.min("b").alias("m"))
        lowest = F.col("b") == F.col("m")
        step = live.join(low, "a").select(F.when(lowest, F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"), (~lowest).alias("more"))
        before, held = held, stash(step.distinct())
        if before is not first:
            discard(before)
        if held.where("more").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    while True:
        up = held.select(F.col("a").alias("b"), F.col("b").alias("m"))
        before, held = held, stash(held.select("a", "b").join(up, "b", "left").select("a", F.coalesce("m", "b").alias("b"), F.col("m").isNotNull().alias("more")))
        discard(before)
        if held.where("more").isEmpty():
            break
    rows = held.select(F.col("a").alias("id"), "b").union(held.select("b", "b")).union(first.where("a = b").select("a", "b"))
    out = stash(rows.groupBy("id").agg(F.min("b").alias("component_id")))
    discard(first, held)
    return out


def join_components(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp, as components() returns it, after further links (a, b) between any nodes, written.

    Only links between the components travel in the rounds, not the components' members."""
    for end in ("a", "b"):
        links = links.join(comp.select(F.col("id").alias(end), F.col("component_id").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    top = components(links)
    moved = comp.join(top.select(F.col("id").alias("component_id"), F.col("component_id").alias("to")), "component_id", "left")
    out = stash(moved.select("id", F.coalesce("to", "component_id").alias("component_id")).union(top).distinct())
    discard(top)
    return out
