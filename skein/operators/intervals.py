"""Points and the intervals that hold them (W5, J13), as equi-joins on dyadic blocks.

An interval of whole numbers is the union of at most two blocks of each size 2^k that no larger block of its own holds; a point lies in
one block of each size. A point therefore meets an interval exactly once if the interval holds it and never otherwise: rows
grow with the points, the logarithm of the longest interval, and the pairs that there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.loops import settle


def cover(low: Column, high: Column) -> Column:
    """array<struct<level, block>>: the blocks of [low, high] (from 0 on); empty if high < low."""
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(high - low + 1, F.lit(1)))).cast("int") + 1)

    def at(k: Column) -> Column:
        size = F.expr("1L") * F.pow(F.lit(2.0), k).cast("long")
        left, right = F.ceil(low / size).cast("long"), F.floor((high + 1) / size).cast("long")
        block = lambda c, b: F.when((left < right) & c, F.struct(k.alias("level"), b.alias("block")))
        return F.array(block(left % 2 == 1, left), block(right % 2 == 1, right - 1))

    return F.filter(F.flatten(F.transform(levels, at)), lambda x: x.isNotNull())


def stab(points: DataFrame, spans: DataFrame, by: list[str], at: str = "at", low: str = "low", high: str = "high") -> DataFrame:
    """points joined with the spans (columns besides `by`, kept) of the same `by` whose [low, high] holds `at`.

    Rows with a null end, point or key meet nothing; repeated rows meet each."""
    own = settle(spans.where(F.col(low) >= 0).withColumn("_c", F.explode(cover(F.col(low).cast("long"), F.col(high).cast("long")))).select("*", "_c.level", "_c.block").drop("_c").withColumnsRenamed({"level": "_level", "block": "_block"}))
    levels = [r["_level"] for r in own.select("_level").distinct().collect()]  # 64 at most
    if not levels:
        levels = [0]
    at_level = points.withColumn("_level", F.explode(F.array(*(F.lit(k) for k in sorted(levels))))).withColumn("_block", F.floor(F.col(at) / F.pow(F.lit(2.0), "_level")).cast("long"))
    return at_level.join(own, [*by, "_level", "_block"]).drop("_level", "_block")


def innermost(points: DataFrame, spans: DataFrame, by: list[str], name: str, at: str = "at", low: str = "low", high: str = "high") -> DataFrame:
    """(by, at, name): of the spans that hold a point the one that begins last; of equal ones the smaller name."""
    held = stab(points.select(*by, at).distinct(), spans.select(*by, low, high, name), by, at, low, high)
    return held.groupBy(*by, at).agg(F.min(F.struct((-F.col(low)).alias("l"), F.col(name).alias("n"))).alias("_b")).select(*by, at, F.col("_b.n").alias(name))


def first_before(points: DataFrame, marks: DataFrame, by: list[str], name: str, at: str = "at") -> DataFrame:
    """points with the first mark (by, at, name) of their key if it stands at or before them, else null.

    One aggregate of the marks: no mark but the first can be the first enclosing one."""
    first = marks.groupBy(*by).agg(F.min(F.struct(F.col(at).alias("a"), F.col(name).alias("n"))).alias("_f"))
    return points.join(first, by, "left").withColumn(name, F.when(F.col("_f.a") <= F.col(at), F.col("_f.n"))).drop("_f")
