"""Nearest neighbours by inner product over additively quantised vectors.

A unit vector is written as the sum of one codeword from each of M full-dimensional codebooks. The codebooks are fitted on a
bounded sample: each by k-means on what the ones before leave, then all of them again by least squares over beam-searched codes.
Encoding is a beam search: of the WIDTH best sums so far each tries all codewords of the next codebook, with products looked
up from a table of codeword products. Every row is encoded, whatever the sample was. Beside its codes a row stores two norms:
the gain |x| / <u, u'> of unit vector u and its approximation u', and the length of what gain times u' leaves of x.

A query makes one lookup table for each codebook, and a row's estimate is its gain times the sum of M looked up values. The
2 k rows of a block with the best estimates are scored on the original vectors; their k-th best score is a lower bound of the
block's. All rows whose estimate plus MARGIN standard errors (|q| times the stored remainder, over the root of the
dimensions) reaches it are scored as well. That has no cap: where a block holds thousands of near copies, all are scored.

Queries and rows are dealt into blocks by a hash; each task holds one block of both, and sends the k best of each query.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, take no part, as rows
without an id; of several rows with one id the smallest vector counts. Vectors meet vectors of the same length only; codebooks
are fitted for the MAX_BOOKS commonest lengths of the sample up to MAX_DIMS dimensions, and blocks of other lengths are scored
exactly. Equal scores are ordered by id; equal vectors have equal estimates and are never told apart before the exact score.
Empty tables and queries without any candidate give no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import discard, ship, stash

TOP, BOOKS, WORDS, WIDTH, MARGIN = 20, 16, 128, 4, 2.0
ROUNDING = 1e-5  # of estimates in single precision, for unit vectors
SAMPLE, SWEEPS = 8_192, 1  # rows to fit on; rounds of least squares
BLOCK, QUERY_BLOCK, STEP = 16_384, 8_192, 256
MAX_BOOKS, MAX_DIMS, SAMPLE_BYTES = 4, 4_096, 1 << 26


def nearest_word(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (x @ words.T - 0.5 * (words * words).sum(axis=1)).argmax(axis=1)


def k_means(x: np.ndarray, k: int, rng, rounds: int = 6) -> np.ndarray:
    words = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = nearest_word(x, words)
        sums, n = np.zeros_like(words), np.bincount(at, minlength=len(words))
        np.add.at(sums, at, x)
        words[n > 0] = sums[n > 0] / n[n > 0, None]
        words[n == 0] = x[rng.integers(0, len(x), int((n == 0).sum()))]
    return words


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[m][codes[:, m]] for m in range(len(books)))


def encode(x: np.ndarray, books: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Codes (rows, M) by beam search; |x - sum|^2 grows by |c|^2 - 2 <x, c> + 2 <sum, c> with each codeword c."""
    m, k, _ = books.shape
    flat = books.reshape(m * k, -1)
    products, squares = flat @ flat.T, (flat * flat).sum(axis=1)
    out = np.empty((len(x), m), np.uint8)
    for i in range(0, len(x), 1024):
        own = x[i : i + 1024]
        n = len(own)
        codes, cost, cross = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1), np.float32), np.zeros((n, 1, m * k), np.float32)
        for b in range(m):
            z = slice(b * k, (b + 1) * k)
            step = (squares[z] - 2.0 * (own @ books[b].T))[:, None, :] + 2.0 * cross[:, :, z] + cost[:, :, None]
            wide = step.reshape(n, -1)
            w = min(width, wide.shape[1])
            pick = np.argpartition(wide, w - 1, axis=1)[:, :w] if w < wide.shape[1] else np.tile(np.arange(w), (n, 1))
            beam, word = pick // k, pick % k
            rows = np.arange(n)[:, None]
            cost, codes = wide[rows, pick], np.concatenate((codes[rows, beam], word[:, :, None]), axis=2)
            if b + 1 < m:
                rest = slice((b + 1) * k, m * k)
                grown = np.zeros((n, w, m * k), np.float32)
                grown[:, :, rest] = cross[rows, beam][:, :, rest] + products[z][word][:, :, rest]
                cross = grown
        out[i : i + n] = codes[np.arange(n), cost.argmin(axis=1)]
    return out


def fit(x: np.ndarray, m: int = BOOKS, k: int = WORDS, sweeps: int = SWEEPS, seed: int = 0) -> np.ndarray:
    """Codebooks (M, K, dims) for unit rows x; with fewer rows than K, codewords repeat."""
    rng, left, books = np.random.default_rng(seed), x.astype(np.float32), []
    for _ in range(m):
        words = k_means(left, min(k, len(left)), rng)
        left = left - words[nearest_word(left, words)]
        books.append(np.concatenate((words, words[np.zeros(k - len(words), np.int64)])))
    books = np.stack(books)
    for _ in range(sweeps):
        codes = encode(x, books)
        # the codewords that lose least for these codes, with a little ridge: (B'B + r) C = B'x, kept near the old ones
        at = codes.astype(np.int64)
        gram = np.block([[np.bincount(at[:, a] * k + at[:, b], minlength=k * k).reshape(k, k) for b in range(m)] for a in range(m)]).astype(np.float32)
        right = np.zeros((m * k, x.shape[1]), np.float32)
        for a in range(m):
            np.add.at(right, at[:, a] + a * k, x)
        ridge = 0.5
        old = books.reshape(m * k, -1)
        books = np.linalg.solve(gram + ridge * np.eye(m * k, dtype=np.float32), right + ridge * old).astype(np.float32).reshape(m, k, -1)
    return books


def norms(x: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gain, remainder) of rows x and the approximations of their unit vectors."""
    size = np.sqrt((x * x).sum(axis=1))
    along = (x * near).sum(axis=1) / size
    gain = np.where(along > 0.05, size / np.maximum(along, 0.05), size)
    return gain, np.sqrt(((x - gain[:, None] * near) ** 2).sum(axis=1))


def estimates(tables: list[np.ndarray], codes: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """(rows, queries) of gain times looked up sums; tables[m] is (K, queries)."""
    total = tables[0][codes[:, 0]]
    held = np.empty_like(total)
    for m in range(1, len(tables)):
        np.take(tables[m], codes[:, m], axis=0, out=held)
        total += held
    total *= gain[:, None].astype(np.float32)
    return total


def vectors(t: pa.Table) -> np.ndarray:
    lists = t.column("v").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def search(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, codes, gain, rest, books, top: int, margin: float):
    """(query index, row index, score) of the `top` best rows of one block for each query, its own id left out."""
    out, few = [], min(2 * top, len(x))
    for i in range(0, len(q), STEP):
        own, own_ids = q[i : i + STEP], q_ids[i : i + STEP]
        if books is None or len(x) <= top:
            r, c = (a.ravel() for a in np.indices((len(own), len(x))))
            other = own_ids[r] != ids[c]
            r, c = r[other], c[other]
        else:
            est = estimates([np.ascontiguousarray((own @ b.T).T.astype(np.float32)) for b in books], codes, gain).T
            r, c = np.nonzero(own_ids[:, None] == ids[None, :])
            est = np.where(np.isfinite(est), est, -np.finfo(np.float32).max)
            est[r, c] = -np.inf
            first = np.argpartition(est, len(x) - few, axis=1)[:, len(x) - few :]
            known = np.where(np.take_along_axis(est, first, axis=1) > -np.inf, np.einsum("ij,ikj->ik", own, x[first]), -np.inf)
            bound = np.partition(known, few - top, axis=1)[:, few - top]  # no more than the true k-th best
            error = (margin / np.sqrt(x.shape[1])) * np.sqrt((own * own).sum(axis=1))[:, None] * rest[None, :]
            may = est + error + ROUNDING * np.sqrt((own * own).sum(axis=1))[:, None] * gain[None, :] >= bound[:, None]
            np.put_along_axis(may, first, True, axis=1)
            r, c = np.nonzero(may & (est > -np.inf))
        score = np.empty(len(r))
        for j in range(0, len(r), 1 << 16):
            score[j : j + (1 << 16)] = np.einsum("ij,ij->i", own[r[j : j + (1 << 16)]], x[c[j : j + (1 << 16)]])
        order = np.lexsort((ids[c], -score, r))
        r, c, score = r[order], c[order], score[order]
        start = np.searchsorted(r, np.arange(len(own)))
        kept = np.arange(len(r)) - start[r] < top
        out.append((r[kept] + i, c[kept], score[kept]))
    return tuple(np.concatenate(a) for a in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def sound(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(id, v, dims) of the rows that take part, one for each id."""
    v = F.col("v")
    ok = v.isNotNull() & F.col("id").isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0.0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).where(ok)
    return rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("dims", F.size("v"))


def fitted(rows: DataFrame, sample: int) -> dict[int, np.ndarray]:
    """Codebooks by length, from the rows with the smallest hashes; sample rows and SAMPLE_BYTES at most reach the driver."""
    lengths = rows.where(F.col("dims") <= MAX_DIMS).groupBy("dims").count().orderBy(F.col("count").desc(), "dims").limit(MAX_BOOKS).collect()
    books = {}
    for dims in (r["dims"] for r in lengths):
        n = max(1, min(sample, SAMPLE_BYTES // (4 * dims)))
        drawn = rows.where(F.col("dims") == dims).orderBy(F.xxhash64("id"), "id").limit(n).select(F.col("v").cast("array<float>").alias("v")).toArrow()
        x = vectors(drawn).astype(np.float64)
        size = np.sqrt((x * x).sum(axis=1, keepdims=True))
        fine = np.isfinite(size[:, 0]) & (size[:, 0] > 0)
        if fine.any():
            books[dims] = fit((x[fine] / size[fine]).astype(np.float32))
    return books


def ann_search(df: DataFrame, query: Column, id_col: str = "vec_id", vec: str = "embedding", top: int = TOP, margin: float = MARGIN, sample: int = SAMPLE, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that fulfils `query` (a condition on `id`) its `top` nearest other rows."""
    from pyspark.sql import Window

    spark = df.sparkSession
    ship(spark)
    rows = stash(sound(df, id_col, vec))
    books = spark.sparkContext.broadcast(fitted(rows, sample))  # BOOKS * WORDS vectors for each of MAX_BOOKS lengths at most

    def coded(batches):
        for batch in batches:
            dims, lists = batch.column(2).to_numpy(), batch.column(1)
            codes, gain, rest = [None] * len(dims), np.zeros(len(dims)), np.zeros(len(dims))
            for d in np.unique(dims):
                if d in books.value:
                    at = np.flatnonzero(dims == d)
                    x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
                    with np.errstate(over="ignore", invalid="ignore"):
                        unit = x / np.abs(x).max(axis=1, keepdims=True)
                        unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
                        own = encode(unit.astype(np.float32), books.value[d])
                        gain[at], rest[at] = norms(x, decode(own, books.value[d]).astype(np.float64))
                    for i, c in zip(at, own, strict=True):
                        codes[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), pa.array(gain), pa.array(rest)], names=["id", "v", "dims", "codes", "gain", "rest"])

    index = stash(rows.mapInArrow(coded, "id long, v array<double>, dims int, codes binary, gain double, rest double"))
    asked = rows.where(query)
    n_rows, n_asked = max(1, -(-index.count() // block)), max(1, -(-asked.count() // query_block))
    dealt = lambda d, own, n, other, m: d.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    keys = ("dims", "_q", "_x")

    def tile(a: pa.Table, c: pa.Table) -> pa.Table:
        r, col, score, ids, own = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if a.num_rows and c.num_rows:
            own, ids = a.column("id").to_numpy(), c.column("id").to_numpy()
            words = books.value.get(c.column("dims")[0].as_py())
            codes = None if words is None else np.frombuffer(b"".join(c.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
            with np.errstate(over="ignore", invalid="ignore"):
                r, col, score = search(vectors(a), own, vectors(c), ids, codes, c.column("gain").to_numpy(), c.column("rest").to_numpy(), words, top, margin)
        return pa.table({"query_id": own[r], "vec_id": ids[col], "score": score})

    found = dealt(asked, "_q", n_asked, "_x", n_rows).groupBy(*keys).cogroup(dealt(index, "_x", n_rows, "_q", n_asked).groupBy(*keys)).applyInArrow(tile, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    out = stash(found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score"))
    discard(rows, index)
    return out


def op11(spark, sf_dir: str) -> DataFrame:
    from skein.llm.common import table

    return ann_search(table(spark, sf_dir, "embeddings"), query=F.col("id") % 20 == 0)
