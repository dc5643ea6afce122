"""Mixing overlapping sources to target weights by min-cost flow.

A document belongs to one source or several. Documents are aggregated by membership pattern; words flow from the
patterns to the sources' quotas. A pattern offers its size once at no cost, and again for each repetition at a
cost that rises with it (convex), up to max_repeats; the cheapest flow of largest value is found on the driver
over patterns alone. Then each pattern takes whole rounds of all its documents and, for what is left, documents
in the order of a seeded hash, the last one in part. The rest of a pattern is located by sums over hash bins, so
that no pattern is gathered or sorted in one task.

The driver holds one row for each pattern; more than max_patterns of them raise an error. Defined results: a null
or empty text has size 0 and takes nothing; a null source is a source, the last in order; documents without any
source take nothing; a null size takes nothing; equal rows count and are taken each alone; empty tables give no rows;
extra columns pass, whatever they are called, but for those named like an output, which are replaced.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# The weights of sources in order, repeating.
WEIGHTS = (3, 1, 2)
BUDGET, MAX_REPEATS, SEED, MAX_PATTERNS, BIN_BITS = 1.5, 2, 17, 100_000, 12


def size_of(text: Column) -> Column:
    """The number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: dict, weights: dict, budget: float, cap: float) -> dict:
    """Each source's share of budget by weight; what exceeds cap times its size is shared again among the others."""
    out, active, left = {}, set(sizes), float(budget)
    while active:
        w = sum(weights[s] for s in active)
        over = [s for s in active if w and left * weights[s] / w > cap * sizes[s]]
        if not over:
            return out | {s: left * weights[s] / w if w else 0.0 for s in active}
        for s in over:
            out[s] = float(cap * sizes[s])
            active.discard(s)
        left -= sum(out[s] for s in over)
    return out


def min_cost_flow(patterns: list[tuple[tuple, int]], quota: dict, max_repeats: int) -> list[dict]:
    """Words from each pattern (members, size) to each of its sources.

    All costs lie on the arcs out of the start, which no augmenting path enters again: cheapest paths first means
    exhausting one repetition level of all patterns before the next is opened. Within a level, words go straight
    to quotas that are short, then along breadth-first augmenting paths that reroute other patterns' words."""
    flow = [dict.fromkeys(m, 0) for m, _ in patterns]
    short = dict(quota)
    users: dict = {}
    for i, (m, _) in enumerate(patterns):
        for s in m:
            users.setdefault(s, []).append(i)
    for _ in range(max_repeats):
        spare = [size for _, size in patterns]
        for i, (m, _) in enumerate(patterns):
            for s in m:
                x = min(spare[i], short[s])
                flow[i][s] += x
                spare[i] -= x
                short[s] -= x
        while any(short.values()):
            start = [i for i, x in enumerate(spare) if x]
            came: dict = {("p", i): None for i in start}
            todo, hit = deque(("p", i) for i in start), None
            while todo and hit is None:
                kind, x = node = todo.popleft()
                if kind == "p":
                    nexts = [("s", s) for s in patterns[x][0]]
                else:
                    nexts = [("p", j) for j in users[x] if flow[j][x]]
                for y in nexts:
                    if y not in came:
                        came[y] = node
                        if y[0] == "s" and short[y[1]]:
                            hit = y
                            break
                        todo.append(y)
            if hit is None:
                break
            path = [hit]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()
            amount = min([spare[path[0][1]], short[hit[1]]] + [flow[b[1]][a[1]] for a, b in zip(path, path[1:]) if a[0] == "s"])
            for a, b in zip(path, path[1:]):
                if a[0] == "p":
                    flow[a[1]][b[1]] += amount
                else:
                    flow[b[1]][a[1]] -= amount
            spare[path[0][1]] -= amount
            short[hit[1]] -= amount
    return flow


def _key(members: Column) -> Column:
    return F.sort_array(F.array_distinct(members))


def _hash(cols: list[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def plan_mix(slim: DataFrame, members: str, size: str, hash_cols: list[str], weights=WEIGHTS, budget=BUDGET, max_repeats=MAX_REPEATS, seed=SEED, max_patterns=MAX_PATTERNS) -> DataFrame:
    """A row for each pattern: _key, rounds, cut_bin and left (words to take within that bin), source sizes and targets.

    At most max_patterns rows. slim is read three times and should be a written table without texts."""
    spark = slim.sparkSession
    d = slim.select(_key(F.col(members)).alias("_key"), F.col(size).alias("_size"), F.shiftrightunsigned(_hash(hash_cols, seed), 64 - BIN_BITS).alias("_bin"))
    found = d.groupBy("_key").agg(F.sum("_size").alias("n")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    found = sorted(((tuple(r[0] or ()), int(r[1] or 0)) for r in found), key=lambda x: [(s is None, s or "") for s in x[0]])
    sizes: dict = {}
    for m, n in found:
        for s in m:
            sizes[s] = sizes.get(s, 0) + n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(order)}, budget * sum(n for _, n in found), max_repeats)
    flow = min_cost_flow(found, {s: round(goal[s]) for s in order}, max_repeats)
    rows = []
    for (m, n), f in zip(found, flow):
        t = sum(f.values())
        rows.append((list(m), t // n if n else 0, t % n if n else 0, [sizes[s] for s in m], [goal[s] for s in m]))
    schema = T.StructType([T.StructField("_key", T.ArrayType(T.StringType())), T.StructField("rounds", T.LongType()), T.StructField("rest", T.LongType()), T.StructField("source_sizes", T.ArrayType(T.LongType())), T.StructField("targets", T.ArrayType(T.DoubleType()))])
    plan = spark.createDataFrame(rows, schema).coalesce(1)
    # the bin of each pattern in which its rest is used up: 2^BIN_BITS sums a pattern at most
    bins = d.where("_size > 0").groupBy("_key", "_bin").agg(F.sum("_size").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("_key").orderBy("_bin"))
    cut = bins.join(F.broadcast(plan.where("rest > 0").select("_key", "rest")), "_key").withColumn("upto", upto).where("upto - n < rest and rest <= upto").select("_key", F.col("_bin").alias("cut_bin"), (F.col("rest") - F.col("upto") + F.col("n")).alias("left"))
    return plan.join(cut, "_key", "left")


PLAN = ("rounds", "source_sizes", "targets")


def apply_mix(df: DataFrame, plan: DataFrame, members: str, size: str, hash_cols: list[str], seed=SEED, max_repeats=MAX_REPEATS) -> DataFrame:
    """df with rounds, source_sizes, targets and taken, the words taken of each row (repeats counted).

    Columns of df named like these four are replaced; all others pass, whatever they are called."""
    outputs = (*PLAN, "taken")
    kept = [c for c in df.columns if c not in outputs]
    d = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), _key(F.col(members)).alias("key"), F.col(size).alias("size"), _hash(hash_cols, seed).alias("h"), *(F.col(c).alias(f"by{i}") for i, c in enumerate(hash_cols)))
    d = d.withColumn("bin", F.shiftrightunsigned("h", 64 - BIN_BITS)).join(F.broadcast(plan.withColumnRenamed("_key", "key")), "key", "left")
    inside = (F.col("bin") == F.col("cut_bin")) & (F.col("size") > 0)
    whole = F.when(F.col("bin") < F.col("cut_bin"), F.col("size")).otherwise(F.lit(0).cast("long"))
    out = d.where(~F.coalesce(inside, F.lit(False))).withColumn("extra", whole)
    # documents of the cut bins alone are ordered: one in 2^BIN_BITS of a pattern's
    w = Window.partitionBy("key").orderBy("h", *(f"by{i}" for i in range(len(hash_cols))), "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(w), F.lit(0))
    part = d.where(inside).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - before)))
    out = out.unionByName(part).withColumn("taken", F.coalesce(F.col("rounds") * F.col("size") + F.col("extra"), F.lit(0)).cast("long"))
    return out.select(*(F.col(f"row.`{c}`") for c in kept), *outputs)


def op6(spark, sf_dir: str) -> DataFrame:
    from skein.llm.common import stash, table

    slim = stash(table(spark, sf_dir, "documents").select("doc_id", "source", size_of(F.col("text")).alias("size")).withColumn("members", F.array("source")))
    plan = stash(plan_mix(slim, "members", "size", ["doc_id", "size"]))
    return apply_mix(slim, plan, "members", "size", ["doc_id", "size"]).select("doc_id", "source", "size", F.col("source_sizes")[0].alias("source_size"), F.col("targets")[0].alias("target"), "taken")
