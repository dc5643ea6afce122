"""Quality classifier by weak labels.

Overlapping heuristic labellers vote good, bad or abstain on each document. Votes of all documents are aggregated
into patterns; expectation-maximisation over the patterns (independent labellers given the hidden class) estimates
each labeller's accuracies where it does not abstain, and the class prior. The posteriors of the patterns are the labels from which a hashed
linear scorer (logistic regression on log counts of hashed words and word shapes) is trained.

Patterns are at most 3^labellers (59,049), whatever the input. Votes are counted over all documents; the scorer
alone is fitted on a bounded sample of about max_train documents, drawn by a hash of the text, half of them from
each side of the posterior where there are enough. No human label is used.

The score is the scorer's probability of good; the verdict `kept` rejects what the posterior and the scorer
together, as the mean of their log-odds, hold more likely bad. Defined results: a null text counts as empty, and
an empty text, on which all but the length labeller abstain, gets that pattern's posterior; equal rows get equal
answers; an empty table gives no rows; extra columns pass through, and those named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import words as W
from skein.llm.common import add_columns, ship

HASH_BITS, MAX_TRAIN, EPOCHS, STEP, L2, EM_ROUNDS = 14, 8_000, 12, 0.5, 1e-4, 60
LABELLERS = ("length", "symbols", "capitals", "digits", "word_length", "variety", "repeated_words", "repeated_lines", "function_words", "exclaims")
# Below the first a labeller's measure is good, above the second bad; between, it abstains.
LIMITS = {"symbols": (0.01, 0.05), "capitals": (0.10, 0.30), "digits": (0.02, 0.10), "word_length": (7.0, 12.0), "repeated_words": (0.02, 0.10), "repeated_lines": (0.05, 0.30), "exclaims": (0.005, 0.03)}
# Frequent function words of four languages.
FUNCTION_WORDS = "the of and to in is that it a for was with be der die und den von das ist nicht le la de et les des est que el los se un por con una las en du".split()
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[ord("!")] = 4
_KIND[[ord(c) for c in "#*$%&|<>{}\\^~=_"]] = 3


_hashes: list[np.ndarray] = []


def _function_hashes() -> np.ndarray:
    if not _hashes:
        data = np.frombuffer(" ".join(FUNCTION_WORDS).encode(), np.uint8)
        starts, ends, _ = W.word_spans(data, np.array([0, len(data)]))
        _hashes.append(W.word_hashes(data, starts, ends))
    return _hashes[0]


def measures(data: np.ndarray, off: np.ndarray):
    """(votes, (labellers) int8 of each text; hashed features) of a slice of texts."""
    starts, ends, bounds = W.word_spans(data, off)
    hashes = W.word_hashes(data, starts, ends)
    kind = _KIND[data]
    csum = [np.concatenate(([0], np.cumsum(kind == k)))[off] for k in (1, 2, 3, 4)]
    votes, feats = np.zeros((len(off) - 1, len(LABELLERS)), np.int8), []
    wordlen = np.concatenate(([0], np.cumsum(ends - starts)))
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        n, chars = b - a, max(1, int(wordlen[b] - wordlen[a]))
        h = hashes[a:b]
        upper, digit, symbol, loud = (int(c[i + 1] - c[i]) / chars for c in csum)
        uniq = len(np.unique(h)) / max(1, n)
        again = float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0
        lines = bytes(data[off[i] : off[i + 1]]).split(b"\n")
        lines = [x for x in lines if x.strip()]
        dup = 1 - len(set(lines)) / max(1, len(lines))
        got = {"symbols": symbol, "capitals": upper, "digits": digit, "word_length": chars / max(1, n), "repeated_words": again, "repeated_lines": dup}
        common = float(np.isin(h, _function_hashes()).mean()) if n else 0.0
        got["exclaims"] = loud
        v = [1 if n >= 50 else -1 if n == 0 else 0]
        for name in LABELLERS[1:]:
            if n < 5:
                v.append(0)
            elif name == "function_words":
                v.append(0 if n < 30 else 1 if common >= 0.10 else -1 if common < 0.05 else 0)
            elif name == "variety":
                v.append(0 if n < 50 else 1 if uniq >= 0.3 else -1 if uniq < 0.15 else 0)
            else:
                lo, hi = LIMITS[name]
                v.append(1 if got[name] <= lo else -1 if got[name] >= hi else 0)
        votes[i] = v
        dense = np.array([np.log1p(n) / 10, min(1, symbol * 5), upper, digit, uniq, again, dup, common, min(1, loud * 5), min(2.0, chars / max(1, n) / 10), 1.0])
        bucket, count = np.unique((h >> np.uint64(64 - HASH_BITS)).astype(np.int64), return_counts=True)
        x = np.log1p(count)
        norm = np.sqrt((x * x).sum())
        feats.append((dense, bucket, x / norm if norm else x))
    return votes, feats


N_DENSE = 11


def pattern_of(votes: np.ndarray) -> np.ndarray:
    """A number for each row of votes, base 3."""
    return ((votes.astype(np.int64) + 1) * 3 ** np.arange(len(LABELLERS))).sum(axis=1)


def votes_of(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS):
    """(posterior of good for each pattern, prior, table[labeller, class, vote]) from how often each pattern occurs."""
    v, c = votes_of(patterns) + 1, counts.astype(float)
    against = (v == 0).sum(axis=1)
    post = np.where(against == 0, 0.95, np.where(against == 1, 0.4, 0.05))  # to begin with, the votes against
    prior, table = 0.5, np.full((len(LABELLERS), 2, 3), 1 / 3)
    for _ in range(rounds):
        for k, p in ((0, 1 - post), (1, post)):
            for j in range(len(LABELLERS)):
                got = np.bincount(v[:, j], weights=p * c, minlength=3) + 0.1
                got[1] = 0.0
                table[j, k] = got / got.sum()
                table[j, k, 1] = 1.0  # to abstain says nothing of the class
        prior = min(0.999, max(0.001, float((post * c).sum() / max(1.0, c.sum()))))
        log = np.log(np.array([1 - prior, prior]))[None, :] + sum(np.log(table[j][:, v[:, j]]).T for j in range(len(LABELLERS)))
        post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
    return post, prior, table


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], label: np.ndarray, epochs=EPOCHS, step=STEP, l2=L2) -> np.ndarray:
    """Weights (dense, then hashed) by averaged gradient steps on soft labels, in a fixed order."""
    w = np.zeros(N_DENSE + (1 << HASH_BITS))
    square = np.full_like(w, 1e-6)
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(rows)).tolist():
            d, b, x = rows[i]
            z = float(w[:N_DENSE] @ d + w[N_DENSE + b] @ x)
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[i]
            at = np.concatenate((np.arange(N_DENSE), N_DENSE + b))
            grad = g * np.concatenate((d, x)) + l2 * w[at]
            square[at] += grad * grad
            w[at] -= step * grad / np.sqrt(square[at])
    return w


class Model:
    def __init__(self, patterns: np.ndarray, post: np.ndarray, prior: float, table: np.ndarray):
        self.post = dict(zip(patterns.tolist(), post.tolist()))
        self.prior, self.table, self.w = prior, table, np.zeros(N_DENSE + (1 << HASH_BITS))

    def __call__(self, text: str | None) -> tuple[int, float, float, bool]:
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        votes, ((d, b, x),) = measures(data, np.array([0, len(data)]))
        return self.verdict(int(pattern_of(votes)[0]), d, b, x)

    def verdict(self, pattern, d, b, x):
        p = self.post.get(pattern, self.prior)
        z = float(self.w[:N_DENSE] @ d + self.w[N_DENSE + b] @ x)
        logit = float(np.log(max(p, 1e-9) / max(1 - p, 1e-9)))
        return pattern, p, float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), bool(np.clip(logit, -20, 20) + np.clip(z, -20, 20) >= 0)


def fit(df: DataFrame, text: str = "text", max_train: int = MAX_TRAIN) -> Model:
    """The label model from the votes of all rows, and the scorer from a bounded sample."""
    ship(df.sparkSession)

    def run(batches):
        for batch in batches:
            for _, data, off in W.slices(batch.column(0)):
                p, n = np.unique(pattern_of(measures(data, off)[0]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(n)], names=["pattern", "n"])

    d = df.select(F.col(text).alias("text"))
    t = d.mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toArrow()
    patterns, counts = t.column("pattern").to_numpy(), t.column("n").to_numpy()
    model = Model(patterns, *em(patterns, counts))
    total = int(counts.sum())
    if not total:
        return model
    share = min(1.0, 4 * max_train / total)
    texts = d.where("text is not null").where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(np.ceil(share * (1 << 20)))).select("text")
    rows, label = [], []
    room = {True: max_train // 2, False: max_train // 2}
    for r in texts.orderBy(F.xxhash64("text"), "text").limit(4 * max_train).toLocalIterator():
        data = np.frombuffer(r[0].encode("utf-8", "surrogatepass"), np.uint8)
        votes, feats = measures(data, np.array([0, len(data)]))
        p = model.post.get(int(pattern_of(votes)[0]), model.prior)
        if room[p >= 0.5] and abs(p - 0.5) > 0.1:
            room[p >= 0.5] -= 1
            rows += feats
            label.append(p)
    if rows:
        model.w = fit_scorer(rows, np.array(label))
    return model


SCHEMA = "pattern long, posterior double, score double, kept boolean"


def classify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)
    return add_columns(df, text, SCHEMA, lambda: shared.value)


def op3(spark, sf_dir: str) -> DataFrame:
    from skein.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, fit(docs)).drop("text")
