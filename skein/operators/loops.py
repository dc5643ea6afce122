"""Cutting lineage between the rounds of a loop."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a side of a join with more rows is not sent to all executors.
FEW = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.gettempdir()}/skein-shared"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """df, written under the shared folder and read back: any executor can be lost afterwards."""
    path = f"{shared_dir(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner see which shuffles nothing refers to any more, so that their files go before the application's end."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sided(df: DataFrame, rows: int) -> DataFrame:
    """df, which has this many rows at most, as a side of a join: few are sent to all executors, more are brought together by key.

    Spark's own guess is the size of the files that settle() wrote, of which a row may have one byte and in the driver a hundred."""
    return F.broadcast(df) if rows <= FEW else df.hint("merge")


def drop_settled(*frames: DataFrame) -> None:
    """Delete what settle() wrote for these frames; only where everything needed of them has been written since."""
    for df in frames:
        if path := getattr(df, "_settled_at", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
