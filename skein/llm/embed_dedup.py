"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Unit vectors are quantised to int8 with one scale a vector, and the norm of what rounding took away is kept. For
unit x, y with quantised u, v: |x.y - u.v| <= |x-u| + |y-v| + |x-u| * |y-v|. Tiles of int8 products (exact in
float32 while 127^2 * dims < 2^24, in float64 beyond) leave out every pair whose upper bound is below the
threshold; only the others are recomputed in double precision. Vectors equal in every component are one class,
compared once and counted as often as they occur.

Vectors are dealt into blocks by a hash; each block meets each other block in one task, which holds two blocks
at most. A task returns no pairs: for each of its classes the number of vectors linked, and one edge to the
smallest class reachable inside the tile, which together keep all components.

Defined results: null or zero vectors, and vectors with null or non-finite components, link with nothing and are
their own component; vectors of different lengths do not link; equal rows with different ids link; of several
rows with one id each counts; null ids take no part in components; extra columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import components, ship, stash

THRESHOLD, BLOCK, STEP = 0.9, 4096, 1024


def classes(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(id, key, unit): key is null for vectors that link with nothing; unit holds the bytes of the unit vector (double)."""
    ship(df.sparkSession)
    sound = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    d = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    sound = sound & F.coalesce(F.exists("v", lambda x: x != 0.0), F.lit(False))
    return d.withColumn("v", F.when(sound, F.transform("v", lambda x: x + 0.0)))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scales, bounds on the norm of the error) of unit rows."""
    scale = np.abs(x).max(axis=1) / 127.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    err = np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
    return q, scale, err


def tile(a, b, threshold: float, same: bool):
    """Links between blocks a and b, (key, weight, unit rows): per class the weight linked, and the smallest key reachable."""
    ka, wa, xa = a
    kb, wb, xb = (ka, wa, xa) if same else b
    qa, sa, ea = quantise(xa)
    qb, sb, eb = (qa, sa, ea) if same else quantise(xb)
    kind = np.float32 if 127 * 127 * xa.shape[1] < 1 << 24 else np.float64
    fa, fb = qa.astype(kind), qb.astype(kind).T.copy()
    na, nb = np.zeros(len(ka), np.int64), np.zeros(len(kb), np.int64)
    left, right = [], []
    for i in range(0, len(ka), STEP):
        z = slice(i, i + STEP)
        approx = (fa[z] @ fb).astype(np.float64) * sa[z, None] * sb[None, :]
        bound = approx + ea[z, None] + eb[None, :] + ea[z, None] * eb[None, :]
        r, c = np.nonzero(bound >= threshold - 1e-9)
        r = r + i
        if same:
            r, c = r[r < c], c[r < c]
        for j in range(0, len(r), 1 << 15):
            rr, cc = r[j : j + (1 << 15)], c[j : j + (1 << 15)]
            hit = np.einsum("ij,ij->i", xa[rr], xb[cc]) >= threshold
            rr, cc = rr[hit], cc[hit]
            np.add.at(na, rr, wb[cc])
            np.add.at(nb, cc, wa[rr])
            left.append(rr)
            right.append(cc)
    if same:
        na = na + nb
    left = np.concatenate(left) if left else np.zeros(0, np.int64)
    right = np.concatenate(right) if right else np.zeros(0, np.int64)
    keys = ka if same else np.concatenate((ka, kb))
    low = reach(keys, left, right if same else right + len(ka))
    return keys, (na if same else np.concatenate((na, nb))), low


def reach(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest key connected to each node."""
    low = keys.copy()
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        if (new == low).all():
            return low
        low = new


def embedding_dedup(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row of df."""
    d = stash(classes(df, id_col, vec))
    groups = d.where("v is not null and id is not null").groupBy("v").agg(F.min("id").alias("key"), F.count("*").alias("w"))
    g = stash(groups)
    n = g.count()
    blocks = max(1, -(-n // block))
    cut = g.withColumn("_b", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).withColumn("_len", F.size("v"))
    # each block goes to its tiles with all others
    dealt = cut.select("key", "w", "v", "_len", "_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_o"))
    dealt = dealt.select(F.least("_b", "_o").alias("t1"), F.greatest("_b", "_o").alias("t2"), "_len", "_b", "key", "w", "v")

    def run(key, t):
        lists = t.column("v").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        x = lists.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        k, w, b = (t.column(c).to_numpy() for c in ("key", "w", "_b"))
        order = np.argsort(k, kind="stable")
        k, w, b, x = k[order], w[order], b[order], x[order]
        t1, t2 = key[0].as_py(), key[1].as_py()
        one = (k[b == t1], w[b == t1], x[b == t1])
        two = one if t1 == t2 else (k[b == t2], w[b == t2], x[b == t2])
        keys, n, low = tile(one, two, threshold, t1 == t2)
        return pa.table({"key": keys, "n": n, "low": low})

    found = stash(dealt.groupBy("t1", "t2", "_len").applyInArrow(run, "key long, n long, low long"))
    links = found.groupBy("key").agg(F.sum("n").alias("n"))
    comp = components(found.where("low <> key").select(F.col("low").alias("a"), F.col("key").alias("b")).distinct())
    by = g.select("v", "key", "w").join(links, "key", "left").join(comp.withColumnRenamed("id", "key"), "key", "left")
    by = by.select("v", "w", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component_id", "key").alias("c"))
    out = d.join(by, "v", "left")
    n_links = F.when(F.col("w").isNull() | F.col("id").isNull(), 0).otherwise(F.col("n") + F.col("w") - 1).cast("long")
    comp_id = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
    return out.select(F.col("id").alias(id_col), n_links.alias("n_links"), comp_id.alias("component_id"), F.coalesce(comp_id == F.col("id"), F.lit(True)).alias("kept"))


def op5(spark, sf_dir: str) -> DataFrame:
    from skein.llm.common import table

    return embedding_dedup(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
with recursive v as (
  select vec_id, [x::double for x in embedding] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), u as (select vec_id, e, sqrt(list_dot_product(e, e)) as n from v),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r as (select vec_id as id, vec_id as root from embeddings union select l.b, r.root from r join l on l.a = r.id),
m as (select id, min(root) as root from r group by id), c as (select a, count(*) as n from l group by a)
select vec_id, coalesce(c.n, 0) as n_links, root as component_id, root = vec_id as kept from embeddings left join c on a = vec_id join m on id = vec_id
"""
