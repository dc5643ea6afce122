"""Hard negatives by bit-sliced integer products.

Each component x becomes the integer floor(256 * x), and a vector travels as its bit planes in two's complement, the
most significant first, with as many planes as its largest component needs. An anchor's product with the planes read so
far leaves an interval: the planes to come can add at most 2^k - 1 to a component, so the rest of the product lies between
(2^k - 1) times the sum of the anchor's negative components and (2^k - 1) times that of its positive ones. After each
plane the pairs whose interval cannot qualify any more are dropped: below the k-th best lower bound, or outside all of
the anchor's windows of scores. What is left after the last plane has its exact score.

Anchors and rows are dealt into blocks by a hash of the id; a task holds one block of each, and returns for each anchor
its best few rows, so that no anchor's rows ever meet in one place. Two passes: positives, then negatives inside the
windows that the positives set. No row is left out: every anchor's block meets every block.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part; neither do
vectors whose largest integer, times the root of their length, reaches 2^31, as a long may not hold their products (0.9
million before scaling at 81 dimensions). Vectors meet only vectors of the same length (empty ones score 0). Of several rows with one id the smallest by label and vector counts. Anchors without a
positive, and positives without a row in their window (all negative scores: the window is empty), have no result rows.
Equal scores are ordered by id. An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import discard, ship, stash

POSITIVES, NEGATIVES, BLOCK, STEP = 5, 10, 4096, 128
LOW, HIGH = 30, 90  # percent of the positive's score
LARGEST = 1 << 31
SLICED = "id long, label long, dims int, bits int, planes binary"


def slice_vectors(batches, scale: int):
    """Record batches (id, label, v) to rows of bit planes."""
    for batch in batches:
        out = []
        for i, label, v in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if i is None or label is None or v is None or any(x is None for x in v):
                continue
            x = np.floor(np.asarray(v, np.float64) * scale)
            if not (np.isfinite(x).all() and np.abs(x).max(initial=0) * np.sqrt(len(x)) < LARGEST):
                continue
            x = x.astype(np.int64)
            bits = 1 + max((int(max(x.max(), -1 - x.min())).bit_length() if len(x) else 0), 0)
            planes = ((x[None, :] >> np.arange(bits - 1, -1, -1)[:, None]) & 1).astype(np.uint8)
            out.append((i, label, len(x), bits, np.packbits(planes, axis=1).tobytes()))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "label", "dims", "bits", "planes"])


def sliced(df: DataFrame, id_col: str, vec: str, label: Column, scale: int) -> DataFrame:
    """(id, label, dims, bits, planes) of the rows that take part, one for each id."""
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec).cast("array<double>").alias("v"))
    rows = rows.mapInArrow(lambda batches: slice_vectors(batches, scale), SLICED)
    first = rows.groupBy("id").agg(F.min(F.struct("label", "dims", "bits", "planes")).alias("r"))
    return first.select("id", "r.*")


def unpack(t: pa.Table) -> np.ndarray:
    """Bits (planes, rows, dims) of a block; vectors with fewer planes repeat their sign."""
    dims, bits, data = t.column("dims")[0].as_py(), t.column("bits").to_numpy(), t.column("planes").to_pylist()
    most = int(bits.max())
    out = np.zeros((most, len(data), dims), np.uint8)
    for b in np.unique(bits):
        at = np.flatnonzero(bits == b)
        raw = np.frombuffer(b"".join(data[i] for i in at), np.uint8).reshape(len(at), b, -1)
        own = np.unpackbits(raw, axis=2, count=dims).transpose(1, 0, 2)
        out[most - b :, at] = own
        out[: most - b, at] = own[0]
    return out


def whole(bits: np.ndarray) -> np.ndarray:
    """The integers of (planes, rows, dims)."""
    n = len(bits)
    weight = [-(1 << (n - 1)), *(1 << k for k in range(n - 2, -1, -1))]
    out = np.zeros(bits.shape[1:], np.int64)
    for w, plane in zip(weight, bits, strict=True):
        out += w * plane.astype(np.int64)
    return out


def search(q: np.ndarray, bits: np.ndarray, may: np.ndarray, low: np.ndarray, high: np.ndarray, top: int):
    """(anchor, window, row, score) of the `top` best rows in each window [low, high] (anchors, windows) of scores.

    may (anchors, rows): the pairs that may count at all. Ties with the last are all returned. Intervals are exact
    integers; a window with low > high holds nothing."""
    planes, n, dims = bits.shape
    if not n or not len(q):
        return (np.zeros(0, np.int64),) * 4
    largest = int(np.abs(q).sum(axis=1).max(initial=0))
    kind = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else object  # sums of one plane are exact
    up, down = np.maximum(q, 0).sum(axis=1), np.minimum(q, 0).sum(axis=1)
    wide = object if largest << planes >= 1 << 62 else np.int64
    up, down, low, high = (x.astype(wide) for x in (up, down, low, high))
    fq, alive, cols = q.astype(kind), may.copy(), np.arange(n)
    part = np.zeros((len(q), n), wide)
    windows = low.shape[1]
    for p in range(planes):
        k = planes - 1 - p
        product = fq @ bits[p][cols].astype(kind).T
        part = part + (product.astype(wide) << k if p else -(product.astype(wide) << k))
        least, most = part + (((1 << k) - 1) * down)[:, None], part + (((1 << k) - 1) * up)[:, None]
        keep = np.zeros_like(alive)
        for j in range(windows):
            lo, hi = low[:, j, None], high[:, j, None]
            fits = alive & (most >= lo) & (least <= hi)
            sure = fits & (least >= lo) & (most <= hi)
            if len(cols) > top:  # of `top` rows that surely lie in the window, the worst lower bound
                bound = np.partition(np.where(sure, least, np.iinfo(np.int64).min // 2), len(cols) - top, axis=1)[:, len(cols) - top]
                fits &= most >= bound[:, None]
            keep |= fits
        alive = keep
        some = alive.any(axis=0)
        if not some.all():
            cols, alive, part = cols[some], alive[:, some], part[:, some]
        if not len(cols):
            break
    found = []
    for j in range(windows):
        fits = alive & (part >= low[:, j, None]) & (part <= high[:, j, None])
        if len(cols) > top:
            bound = np.partition(np.where(fits, part, np.iinfo(np.int64).min // 2), len(cols) - top, axis=1)[:, len(cols) - top]
            fits &= part >= bound[:, None]
        r, c = np.nonzero(fits)
        found.append((r, np.full(len(r), j), cols[c], part[r, c].astype(np.int64)))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))


def first_few(r, j, ids, score, top: int):
    """Indices of the first `top` of each (r, j), by score downwards, then id."""
    order = np.lexsort((ids, -score, j, r))
    group = np.flatnonzero(np.r_[True, (np.diff(r[order]) != 0) | (np.diff(j[order]) != 0)]) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(group, np.diff(np.r_[group, len(order)]))
    return order[rank < top]


def tiles(rows: DataFrame, anchors: DataFrame, block: int, run, schema: str) -> DataFrame:
    """run(anchors' block, rows' block) in a task for each pair of blocks of equal dims."""
    n_rows, n_anchors = max(1, -(-rows.count() // block)), max(1, -(-anchors.count() // block))
    dealt = lambda df, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    a, c = dealt(anchors, "_a", n_anchors, "_c", n_rows), dealt(rows, "_c", n_rows, "_a", n_anchors)
    keys = ("dims", "_a", "_c")
    return a.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(run, schema)


def best(found: DataFrame, by: list[str], top: int) -> DataFrame:
    """The first `top` rows of each group, with their rank; tasks have sent a few of each group already."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top)


def hard_negatives(df: DataFrame, anchor: Column, label: Column | None = None, id_col: str = "vec_id", vec: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its
    `positives` nearest rows of the same label, the first `negatives` rows of other labels whose score is between low
    and high percent of the positive's. anchor: a condition on `id`. label: the label's expression in df's columns."""
    rows = stash(sliced(df, id_col, vec, F.col("label") if label is None else label, scale))
    anchors = rows.where(anchor)

    def blocks(a: pa.Table, c: pa.Table):
        """Of both blocks: ids, labels, and the anchors' integers or the rows' bits."""
        qa, bits = whole(unpack(a)), unpack(c)
        order = np.argsort(c.column("id").to_numpy(), kind="stable")
        return (a.column("id").to_numpy(), a.column("label").to_numpy(), qa), (c.column("id").to_numpy()[order], c.column("label").to_numpy()[order], bits[:, order])

    def nearest(a: pa.Table, c: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 3]
        if a.num_rows and c.num_rows:
            (ids, labels, q), (other, kinds, bits) = blocks(a, c)
            ends = np.array([-(1 << 62), 1 << 62], np.int64)
            for i in range(0, len(ids), STEP):
                z = slice(i, i + STEP)
                may = (labels[z, None] == kinds[None, :]) & (ids[z, None] != other[None, :])
                n = len(ids[z])
                r, j, col, score = search(q[z], bits, may, np.full((n, 1), ends[0]), np.full((n, 1), ends[1]), positives)
                few = first_few(r, j, other[col], score, positives)
                out.append((ids[z][r[few]], other[col[few]], score[few]))
        return pa.table(dict(zip(("anchor_id", "id", "score"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))

    near = stash(tiles(rows, anchors, block, nearest, "anchor_id long, id long, score long"))
    pos = stash(best(near, ["anchor_id"], positives).select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("at")))
    windows = pos.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("at", "positive_score"))).alias("windows"))  # `positives` at most
    wanted = stash(anchors.join(windows, F.col("id") == F.col("anchor_id")).drop("anchor_id"))

    def windowed(a: pa.Table, c: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 4]
        if a.num_rows and c.num_rows:
            (ids, labels, q), (other, kinds, bits) = blocks(a, c)
            lo, hi = np.ones((len(ids), positives), np.int64), np.zeros((len(ids), positives), np.int64)
            for i, own in enumerate(a.column("windows").to_pylist()):
                for w in own:  # the integers s with low * p <= 100 * s <= high * p
                    lo[i, w["at"]], hi[i, w["at"]] = -((-low * w["positive_score"]) // 100), (high * w["positive_score"]) // 100
            for i in range(0, len(ids), STEP):
                z = slice(i, i + STEP)
                may = labels[z, None] != kinds[None, :]
                r, j, col, score = search(q[z], bits, may, lo[z], hi[z], negatives)
                few = first_few(r, j, other[col], score, negatives)
                out.append((ids[z][r[few]], j[few], other[col[few]], score[few]))
        return pa.table(dict(zip(("anchor_id", "at", "id", "score"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True)))

    far = stash(tiles(rows, wanted, block, windowed, "anchor_id long, at long, id long, score long"))
    chosen = best(far, ["anchor_id", "at"], negatives).join(pos.withColumn("at", F.col("at").cast("long")), ["anchor_id", "at"])
    out = stash(chosen.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    discard(rows, near, pos, wanted, far)
    return out


def op13(spark, sf_dir: str) -> DataFrame:
    from skein.llm.common import table

    df = table(spark, sf_dir, "embeddings")
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(df, anchor=F.col("id") % 100 == 0, label=changed)


ORACLE_SQL = """
with v as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double)::bigint for x in embedding] as e from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.id as anchor_id, b.id as id, a.label = b.label as same, list_dot_product(a.e::double[], b.e::double[])::bigint as score
  from v a join v b on a.id <> b.id and len(a.e) = len(b.e) where a.id % 100 = 0
), p as (
  select anchor_id, id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select p.anchor_id, positive_id, (row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id))::integer as rank, s.id as negative_id, positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score
qualify rank <= 10
"""
