"""Nearest neighbours, spelling variants and hard negatives against brute force, and defined results on odd input."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import additive_ann, hard_negatives, spelling

VECS = "vec_id long, embedding array<float>, label int"


def clustered(n, dims, seed, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, dims))
    label = rng.integers(0, 10, n)
    x = centres[label] * 0.5 + rng.normal(size=(n, dims))
    if copies:  # near copies of one vector, more than any shortlist
        x[:copies] = x[0] + 0.05 * rng.normal(size=(copies, dims))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True) * rng.uniform(0.5, 2.0, (n, 1))).astype(np.float32)
    return x, label


# additive quantisation


def test_beam_codes_are_no_worse_than_greedy_ones():
    x, _ = clustered(1500, 16, 1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = additive_ann.fit(x[:800], 4, 32, 1)
    lost = [((x - additive_ann.decode(additive_ann.encode(x, books, w), books)) ** 2).sum(axis=1) for w in (1, 4, 16)]
    assert lost[0].mean() >= lost[1].mean() >= lost[2].mean()
    left = x.copy()
    for b in books:
        left -= b[additive_ann.nearest_word(left, b)]
    assert np.allclose((left**2).sum(axis=1), lost[0], atol=1e-3)
    codes = additive_ann.encode(x, books)
    gain, rest = additive_ann.norms(x.astype(float), additive_ann.decode(codes, books).astype(float))
    q = x[:5].astype(float)
    est = additive_ann.estimates([np.ascontiguousarray((b @ q.T).astype(np.float32)) for b in books], codes, gain)
    assert np.allclose(est, gain[:, None] * (additive_ann.decode(codes, books) @ q.T), atol=1e-3)
    assert (np.abs(est - x @ q.T) <= rest[:, None] * np.linalg.norm(q, axis=1) + 1e-4).all()


@pytest.mark.parametrize("blocks", [(16_384, 8_192), (700, 40)])
def test_ann_recall(spark, blocks):
    x, label = clustered(3000, 32, 2, copies=900)
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))], VECS)
    got = additive_ann.ann_search(df, F.col("id") % 20 == 0, block=blocks[0], query_block=blocks[1], sample=1000).collect()
    y = x.astype(float)
    want = hits = 0
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert sorted(by) == list(range(0, 3000, 20))
    for q, rows in by.items():
        s = y @ y[q]
        order = [int(i) for i in np.lexsort((np.arange(len(s)), -s)) if i != q][:20]
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)
        assert all(abs(r["score"] - s[r["vec_id"]]) < 1e-12 for r in rows)
        want, hits = want + 20, hits + len(set(order) & {r["vec_id"] for r in rows})
    assert hits >= 0.95 * want


def test_ann_returns_all_that_there_are(spark):
    """Few vectors, all of them fitted: estimates are nearly exact, and every query has its 20, or all others."""
    for n in (15, 300):
        x, label = clustered(n, 16, 3)
        df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))], VECS)
        got = additive_ann.ann_search(df, F.col("id") % 20 == 0).collect()
        s = x[::20].astype(float) @ x.astype(float).T
        for q in range(0, n, 20):
            order = [int(i) for i in np.lexsort((np.arange(n), -s[q // 20])) if i != q][:20]
            assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == order


def test_ann_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, None, 1), (2, [0.0, 0.0], 1), (3, [float("nan"), 1.0], 1), (4, [None, 1.0], 1), (5, [], 1), (None, [1.0, 1.0], 1),
            (7, [1.0, 0.5], 1), (8, [1.0, 0.5], 1), (9, [2.0] * 3, 1), (20, [-1.0, 0.0], 1), (20, [-1.0, 0.0], 1), (40, [1.0] * 3, 1), (60, [1.0] * 5000, 2)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], VECS + ", score string, rank string")
    got = [tuple(r) for r in additive_ann.ann_search(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7, 1.0), (0, 2, 8, 1.0), (0, 3, 20, -1.0), (20, 1, 0, -1.0), (20, 2, 7, -1.0), (20, 3, 8, -1.0), (40, 1, 9, 6.0)]
    assert additive_ann.ann_search(df.limit(0), F.col("id") % 20 == 0).count() == 0


# spelling variants


def variants(rows, min_length=5, min_count=3, every=97):
    counts = Counter()
    for d, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = re.sub("[A-Z]", lambda m: m[0].lower(), r)
            h = zlib.crc32(f"{'' if d is None else d}:{r}".encode())
            counts[r[: h % len(r)] + r[h % len(r) + 1 :] if h % every == 0 else r] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    letters, out = sorted(set("".join(words))), {}
    for w, n in words.items():
        near = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in ["", *letters]}
        near = [v for v in near if v != w and v in words]
        best = min(((-words[v], v) for v in near), default=(0, None))
        form = best[1] if best[1] and -best[0] >= 2 * n else None
        out[w] = (form, n, len(near), words[form] if form else None)

    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return {w: (v[0], root(w), *v[1:]) for w, v in out.items()}


def test_spelling_equals_brute_force(spark):
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(4, 8))) for _ in range(60)] + ["listen", "silent", "enlist", "tinsel", "aaaaa", "aaaaaa", "aaaaaaa", "straße", "strasse", "Über×÷"]
    stems += [s[:i] + rng.choice("abÉz") + s[i + 1 :] for s in stems for i in [rng.randrange(len(s))]]
    rows = [(i if i % 9 else None, " ".join(rng.choices(stems, [1 / (k + 1) for k in range(len(stems))], k=rng.randint(0, 300)))) for i in range(60)]
    rows += [(99, None), (100, ""), (101, "a" * 300_000), (101, "1234 _ !"), (7, rows[7][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, word int").withColumn("n", F.lit("x"))
    got = spelling.spelling_variants(df, every=7).collect()
    have = {r["word"]: tuple(r)[1:] for r in got}
    assert len(have) == len(got) and have == variants(rows, every=7) and any(v[0] and v[0] != v[1] for v in have.values())
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_spelling_of_one_long_run_and_ties(spark):
    text = " ".join(["a" * 70_000] * 3 + ["a" * 70_001] * 6 + ["words", "words", "words", "wordt"] + ["wordt"] * 6 + ["wordq"] * 7)
    got = {r["word"]: tuple(r)[1:] for r in spelling.spelling_variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), every=10**9).collect()}
    assert got["a" * 70_000] == ("a" * 70_001, "a" * 70_001, 3, 1, 6)
    assert got["words"] == ("wordq", "wordq", 3, 2, 7) and got["wordt"] == (None, "wordt", 7, 2, None)


# hard negatives


def mined(rows, every=100, low=30, high=90, positives=5, negatives=10, scale=256):
    v = {}
    for i, e, k in rows:
        if i is None or k is None or e is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        k = (k + 1) % 10 if i % 7 == 0 else k
        v[i] = min(v.get(i, (k, e)), (k, e))
    v = {i: (k, [int(np.floor(scale * float(np.float32(x)))) for x in e]) for i, (k, e) in v.items()}
    out = []
    for a, (k, q) in v.items():
        if a % every:
            continue
        s = sorted((-sum(x * y for x, y in zip(q, w)), i, kind) for i, (kind, w) in v.items() if i != a and len(w) == len(q))
        for p, pid, _ in [t for t in s if t[2] == k][:positives]:
            fit = [(n, i) for n, i, kind in s if kind != k and low * -p <= 100 * -n <= high * -p][:negatives]
            out += [(a, pid, r + 1, i, -p, -n) for r, (n, i) in enumerate(fit)]
    return sorted(out)


def label():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


@pytest.mark.parametrize("block", [4096, 150])
def test_hard_negatives_equal_brute_force(spark, block):
    x, kinds = clustered(900, 12, 5, copies=150)
    x = np.round(x * 8) / 8  # many ties
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, kinds))]
    rows[200] = (200, [9000.0] * 12, 3)  # more planes than the others
    got = sorted(map(tuple, hard_negatives.hard_negatives(spark.createDataFrame(rows, VECS), F.col("id") % 50 == 0, label(), block=block).collect()))
    assert got == mined(rows, every=50) and len(got) > 100


def test_hard_negatives_odd_rows(spark):
    rows = [(0, [1.0, 1.0], 0), (1, [1.0, 1.0], 1), (2, [0.5, 0.5], 2), (2, [0.5, 0.5], 2), (3, None, 2), (4, [None, 1.0], 2), (5, [float("inf"), 1.0], 2), (6, [0.5, 0.5], None), (None, [0.5, 0.5], 2),
            (8, [1.0], 2), (9, [0.5, 0.5], 2), (100, [], 4), (11, [], 4), (12, [], 5), (200, [-1.0, -1.0], 9), (15, [1.0, 1.0], 9), (16, [3e38, 1.0], 2)]
    df = spark.createDataFrame([(*r, 7) for r in rows], VECS + ", id int")
    got = sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("id") % 100 == 0, label()).collect()))
    assert got == mined(rows[:-1]) and (0, 1, 1, 2, 131072, 65536) in got and (100, 11, 1, 12, 0, 0) in got
    assert hard_negatives.hard_negatives(df.limit(0), F.col("id") % 100 == 0, label()).count() == 0


def test_intervals_hold_for_any_products():
    rng = np.random.default_rng(6)
    for scale in (3, 300, 1 << 29):
        y, q = rng.integers(-scale, scale, (80, 7)), rng.integers(-scale, scale, (9, 7))
        n = int(max(y.max(), -1 - y.min())).bit_length() + 1
        bits = ((y[None] >> np.arange(n - 1, -1, -1)[:, None, None]) & 1).astype(np.uint8)
        assert (hard_negatives.whole(bits) == y).all()
        exact = q.astype(object) @ y.T.astype(object)
        low = np.array([[int(np.percentile(row.astype(float), 20))] for row in exact], object).astype(np.int64)
        high = np.array([[int(np.percentile(row.astype(float), 90))] for row in exact], object).astype(np.int64)
        r, _, c, s = hard_negatives.search(q, bits, np.ones((9, 80), bool), low, high, 10)
        assert all(exact[a, b] == t for a, b, t in zip(r, c, s))
        for a in range(9):
            inside = sorted((v for v in exact[a] if low[a, 0] <= v <= high[a, 0]), reverse=True)
            assert sorted(s[r == a].tolist(), reverse=True)[:10] == inside[:10]
