"""Language identification by multilingual mixture inference.

A model holds, for each language of the training labels, log-likelihoods of hashed byte trigrams of lower-cased
words (with word edges). A text is cut into units of a few words; expectation-maximisation estimates the
proportions of the languages in it, with the units' languages hidden. The set of languages is selected by
penalised likelihood: starting with all, the least of them goes as long as that raises log-likelihood minus
`penalty` * log(units) for each language held. The prediction is the largest proportion; the score is it.

Fitting counts trigrams on a bounded sample: about max_train distinct labelled texts, as many of each language (all,
where there are fewer), drawn by a hash of the text. Every language is learned. The model is n_langs * 2^hash_bits
floats; more than max_langs languages raise an error.

Defined results: a null text, or one without a letter, is `und` with score 0; without training labels every text
is `und`; null labels are not learned from; equal texts count once in the fit and get equal answers; very long texts
are read whole; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import words as W

HASH_BITS, MAX_TRAIN, MAX_LANGS, UNIT_WORDS, ROUNDS, PENALTY = 15, 20_000, 1024, 6, 8, 1.0
_A, _B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
#: Everything in ASCII that is no letter ends a word; bytes of other characters belong to words.
STOPS = bytes(c for c in range(128) if not (65 <= c <= 90 or 97 <= c <= 122))


def trigrams(data: np.ndarray, off: np.ndarray, bits: int = HASH_BITS):
    """(bucket of the trigram around each byte of a word, word starts, word ends, words before each text)."""
    starts, ends, bounds = W.word_spans(data, off, STOPS)
    if not len(starts):
        return np.zeros(0, np.int64), starts, ends, bounds
    c = W.LOWER[data].astype(np.uint32) + 1
    before, after = np.zeros_like(c), np.zeros_like(c)
    before[1:], after[:-1] = c[:-1], c[1:]
    before[starts], after[ends - 1] = 0, 0
    h = ((before * np.uint32(258) + c) * np.uint32(258) + after) * _A
    h ^= h >> np.uint32(15)
    h *= _B
    return (h >> np.uint32(32 - bits)).astype(np.int64), starts, ends, bounds


class Model:
    """langs and their log-likelihoods, (2^bits, langs) float32."""

    def __init__(self, langs: list[str], counts: np.ndarray, bits: int, unit_words: int, rounds: int, penalty: float):
        self.langs, self.bits, self.unit_words, self.rounds, self.penalty = langs, bits, unit_words, rounds, penalty
        c = counts.astype(np.float64) + 0.5
        self.ll = np.ascontiguousarray(np.log(c / c.sum(axis=0, keepdims=True)).astype(np.float32))

    def units(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihoods of each unit, units before each text)."""
        buckets, starts, ends, bounds = trigrams(data, off, self.bits)
        n_words = np.diff(bounds)
        per = -(-n_words // self.unit_words)
        first = np.concatenate(([0], np.cumsum(per)))
        n = int(first[-1])
        if not n:
            return np.zeros((0, len(self.langs)), np.float32), first
        which = np.repeat(np.arange(len(per)), per)
        w0 = bounds[which] + (np.arange(n) - first[which]) * self.unit_words
        # byte 0 up to a unit's start: stops carry nothing, so that sums may run over them
        lengths = ends - starts
        inside = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        byte0 = np.concatenate(([0], np.cumsum(lengths)))[w0]
        got = self.ll[buckets[inside]]
        return np.add.reduceat(got, byte0, axis=0), first

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(proportions of each text, units of each text)."""
        ll, first = self.units(data, off)
        n_docs, n_langs = len(off) - 1, len(self.langs)
        n = np.diff(first)
        theta = np.full((n_docs, n_langs), 1.0 / n_langs)
        live = np.flatnonzero(n)
        if not len(live):
            return theta, n
        top = ll.max(axis=1, keepdims=True)
        p = np.exp((ll - top).astype(np.float64)) + 1e-12
        doc, start = np.repeat(np.arange(len(live)), n[live]), first[live]
        th, held = np.full((len(live), n_langs), 1.0 / n_langs), np.ones((len(live), n_langs), bool)

        def em(th, rows, p, doc, start):
            for _ in range(self.rounds):
                r = p * th[doc]
                r /= r.sum(axis=1, keepdims=True)
                th = np.add.reduceat(r, start, axis=0) / rows[:, None]
            return th, np.add.reduceat(np.log((p * th[doc]).sum(axis=1)), start)

        rows = n[live].astype(float)
        th, like = em(th, rows, p, doc, start)
        at = np.arange(len(live))
        for _ in range(n_langs - 1):  # texts whose set has settled take no further part
            trial = np.where(held[at], th[at], np.inf)
            drop = trial.argmin(axis=1)
            cut = th[at].copy()
            cut[np.arange(len(at)), drop] = 0.0
            s = cut.sum(axis=1, keepdims=True)
            keep_left = held[at].copy()
            keep_left[np.arange(len(at)), drop] = False
            cut = np.where(s > 0, cut / np.where(s > 0, s, 1), keep_left / np.maximum(1, keep_left.sum(axis=1, keepdims=True)))
            pick = np.repeat(np.isin(np.arange(len(live)), at), n[live]) if len(at) < len(live) else slice(None)
            pp = p[pick]
            m = n[live][at]
            sub_doc, sub_start = np.repeat(np.arange(len(at)), m), np.concatenate(([0], np.cumsum(m)[:-1]))
            th2, like2 = em(cut, rows[at], pp, sub_doc, sub_start)
            better = like2 - like[at] + self.penalty * np.log(rows[at] + 1.0) > 0
            better &= held[at].sum(axis=1) > 1
            win = at[better]
            th[win], like[win] = th2[better], like2[better]
            held[win, drop[better]] = False
            at = win
            if not len(at):
                break
        theta[live] = th
        return theta, n


def count_trigrams(df: DataFrame, langs: list[str], bits: int) -> np.ndarray:
    """Counts (2^bits, langs) over the rows (text, lang) of df, summed in the tasks first."""
    from skein.llm.common import ship

    ship(df.sparkSession)

    def run(batches):
        total = np.zeros((1 << bits, len(langs)), np.int64)
        for batch in batches:
            lang = batch.column(1).to_pylist()
            for i, data, off in W.slices(batch.column(0)):
                buckets, starts, ends, bounds = trigrams(data, off, bits)
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, ends, -1)
                inside = np.cumsum(edge[:-1]) > 0
                for k in range(len(off) - 1):
                    if lang[i + k] in langs:
                        z = slice(off[k], off[k + 1])
                        total[:, langs.index(lang[i + k])] += np.bincount(buckets[z][inside[z]], minlength=1 << bits) if len(buckets) else 0
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["cell", "n"])

    cells = df.select("text", "lang").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((1 << bits) * len(langs), np.int64)
    out[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    return out.reshape(1 << bits, len(langs))


def fit(labelled: DataFrame, max_train=MAX_TRAIN, max_langs=MAX_LANGS, bits=HASH_BITS, unit_words=UNIT_WORDS, rounds=ROUNDS, penalty=PENALTY) -> Model | None:
    """A model from rows (text, lang); None without labels."""
    d = labelled.where("lang is not null and text is not null")
    h = F.xxhash64("text")
    by = {r[0]: r[1] for r in d.select("lang", h.alias("h")).distinct().groupBy("lang").agg(F.count("*").alias("n")).limit(max_langs + 1).collect()}
    if not by:
        return None
    if len(by) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    quota = max(1, max_train // len(by))
    cuts = d.sparkSession.createDataFrame([(k, min(1 << 20, -(-quota * (1 << 20) // n))) for k, n in by.items()], "lang string, cut long")
    drawn = d.select("text", "lang").join(F.broadcast(cuts), "lang").where(F.pmod(h, F.lit(1 << 20)) < F.col("cut")).dropDuplicates(["lang", "text"])
    langs = sorted(by)
    return Model(langs, count_trigrams(drawn, langs, bits), bits, unit_words, rounds, penalty)


def identify(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """df with lang_pred, score and mixture (the languages held and their proportions)."""
    from pyspark.sql import types as T
    from skein.llm.common import ship

    new = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("mixture", T.MapType(T.StringType(), T.DoubleType()))])
    df = df.drop(*new.names)
    if model is None:
        return df.select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.create_map().cast("map<string,double>").alias("mixture"))
    ship(df.sparkSession)
    at, names = df.columns.index(text), [*df.columns, *new.names]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import regex

        letter, m = regex.compile(r"\p{L}"), shared.value
        for batch in batches:
            texts = batch.column(at)
            lang, score, mix = [], [], []
            for i, data, off in W.slices(texts):
                theta, n = m.predict(data, off)
                best = theta.argmax(axis=1)
                for k in range(len(n)):
                    t = texts[i + k].as_py() if n[k] < 5 else None
                    if n[k] == 0 or (n[k] < 5 and not letter.search(t or "")) or (n[k] >= 5 and not _has_ascii(data, off, k) and not letter.search(texts[i + k].as_py())):
                        lang.append("und")
                        score.append(0.0)
                        mix.append([])
                    else:
                        lang.append(m.langs[best[k]])
                        score.append(float(min(1.0, theta[k, best[k]])))
                        mix.append([(m.langs[j], float(theta[k, j])) for j in np.flatnonzero(theta[k] > 1e-6)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(mix, pa.map_(pa.string(), pa.float64()))], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *new.fields]))


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _has_ascii(data: np.ndarray, off: np.ndarray, k: int) -> bool:
    return bool(_LETTER[data[off[k] : off[k + 1]]].any())


def op2(spark, sf_dir: str) -> DataFrame:
    from skein.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = fit(docs.where(F.coalesce(fold, F.lit(0)) != 2))
    out = identify(docs.select("doc_id", "text", F.coalesce(fold == 2, F.lit(False)).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", F.to_json("mixture").alias("mixture"))
