"""Packing by lexical retrieval: a sharded BM25 index returns unused neighbours that fill each window.

Documents are tokenised, an end id is appended, and whole windows of a long document are cut off at once: what is
left, below one window, is the document's unit. Units are dealt into shards of shard_docs by content: they are ordered
by the smallest hash of their token pairs (copies and near copies share it with the chance of their similarity), then
by a seeded hash, cut into ranges, and each range into shards of consecutive units. Copies and near copies thus meet,
whatever the size of the input, and a group of any size is split by the seeded hash. Each shard holds a
BM25 inverted index of its own, whose terms are the token ids. Documents are seeds in the order of the hash: the
index returns a seed's best unused neighbours, which greedily fill its window, and is asked again until no unused
document shares a query term; when one does not fit, it is cut at the window's edge and its remainder opens the next
window, so that windows are full. What the last window of a shard holds is cut into lengths that are powers of two,
which need no padding.

Document frequencies and lengths come from the units of all documents, as it is the units that fill windows: a row
for each id of the vocabulary reaches the driver, whatever the input.

Defined results: a null or empty text is the end id alone; equal rows are packed each alone; rows with a null id are packed as any other; ties go by hash, then id; very long texts are cut
into whole windows at once; an empty table gives no rows; extra columns are dropped, whatever they are called.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.bpe import Encoder
from skein.llm.common import ship, stash
from skein.llm.words import mix

WINDOW, END_ID, SHARD_DOCS, QUERY_TERMS, NEIGHBOURS, SEED, K1, B = 2048, 1, 2048, 12, 24, 29, 1.2, 0.75
#: Shards in a range of units, which one task fills one after the other.
SHARDS = 4
DEFAULT_TOKENIZER = "word_bpe_49k.json"


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file, with what it has cached."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


ROW = "id long, doc_tokens long, whole array<long>, rest binary, h long, near long"
_TYPES = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64()]


def tokenised(df: DataFrame, id_col: str, text: str, path: str, window: int, seed: int) -> DataFrame:
    """A row for each document: crc32 of each whole window, and the ids of its unit (two bytes each)."""
    ship(df.sparkSession)
    names = [c.split()[0] for c in ROW.split(", ")]

    def run(batches):
        of, again = encoder(path), {}
        for batch in batches:
            for part in _parts(batch):
                rows = []
                for i, e in zip(part.column(0).to_pylist(), of.encode(part.column(1).to_pylist())):
                    x = np.append(np.frombuffer(e, "<u2"), np.uint16(END_ID)).astype("<u4")
                    whole = len(x) // window
                    crcs = [zlib.crc32(x[j * window : (j + 1) * window].tobytes()) for j in range(whole)]
                    unit = x[whole * window :]
                    rest = unit.astype("<u2").tobytes()
                    h = zlib.crc32(rest, zlib.crc32(f"{seed}:{i}:{len(x)}".encode()))
                    if n := again.get(h, 0):  # equal rows get hashes of their own
                        h = zlib.crc32(f"{h}:{n}".encode())
                    again[h] = n + 1
                    rows.append((i, len(x), crcs, rest, h, least_pair(unit)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=names)
            if len(again) > 1_000_000:
                again.clear()

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text)).mapInArrow(run, ROW)


def _parts(batch: pa.RecordBatch, most_rows: int = 1024, most_bytes: int = 4 << 20):
    """Consecutive rows of a batch, so many and of so many bytes of text at most, one at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < batch.num_rows:
        before = int(size[a - 1]) if a else 0
        b = max(a + 1, min(a + most_rows, int(np.searchsorted(size, before + most_bytes, "right"))))
        yield batch.slice(a, b - a)
        a = b


def least_pair(ids: np.ndarray) -> int:
    """The smallest hash of two consecutive ids."""
    x = ids.astype(np.uint64)
    x = x[:-1] * np.uint64(0x9E3779B97F4A7C15) + x[1:] if len(x) > 1 else x
    return int(mix(x).min() >> np.uint64(1)) if len(x) else 0


def statistics(rows: DataFrame) -> tuple[dict[int, int], int, int]:
    """(units with each token id, units, ids) over the units of all documents."""

    def run(batches):
        total, units, n = np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            for r in batch.column(0):
                x = np.frombuffer(r.as_buffer(), "<u2")
                total[np.unique(x)] += 1
                units, n = units + 1, n + len(x)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(total[at], [units, n]))], names=["term", "n"])

    t = rows.select("rest").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    got = dict(zip(t.column("term").to_pylist(), t.column("n").to_pylist()))
    return got, got.pop(-1, 0), got.pop(-2, 0)


def weigh(rest: list[np.ndarray], stats) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct terms of each unit and their BM25 weights."""
    got, units, ids = stats
    df = np.zeros(1 << 16)
    df[list(got)] = list(got.values())
    idf = np.log1p((units - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean, terms, weights = max(1.0, ids / max(1, units)), [], []
    for r in rest:
        t, n = np.unique(r, return_counts=True)
        terms.append(t)
        weights.append((idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(r) / mean))).astype(np.float32))
    return terms, weights


class Index:
    """BM25 postings of a shard: for each term its documents and weights."""

    def __init__(self, terms: list[np.ndarray], weights: list[np.ndarray]):
        n = np.array([len(t) for t in terms])
        term, self.weight = np.concatenate(terms), np.concatenate(weights)
        doc = np.repeat(np.arange(len(terms)), n)
        order = np.argsort(term, kind="stable")
        term, self.doc, self.weight = term[order], doc[order], self.weight[order]
        self.terms, self.start = np.unique(term, return_index=True)
        self.stop = np.append(self.start[1:], len(term))
        self.n = len(terms)

    def neighbours(self, query: np.ndarray, unused: np.ndarray, most: int) -> np.ndarray:
        """Unused documents by falling score; ties by place in the shard."""
        at = np.searchsorted(self.terms, query)
        ok = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == query)
        parts = [slice(self.start[i], self.stop[i]) for i in at[ok].tolist()]
        if not parts:
            return np.zeros(0, np.int64)
        docs, weights = np.concatenate([self.doc[p] for p in parts]), np.concatenate([self.weight[p] for p in parts])
        keep = unused[docs]
        docs, weights = docs[keep], weights[keep]
        if not len(docs):
            return docs
        score = np.bincount(docs, weights)
        found = np.flatnonzero(score > 0)
        if len(found) > most:
            found = found[np.argpartition(-score[found], most)[:most]]
        return found[np.lexsort((found, -score[found]))]


def fill(lengths: np.ndarray, terms: list[np.ndarray], weights: list[np.ndarray], window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, first id, ids) of the rests of a shard, full but for the last ones."""
    n = len(lengths)
    unused = lengths > 0
    out, seq, room, at = [], [], window, 0
    if n == 0 or not unused.any():
        return out
    index = Index(terms, weights)
    current = None
    while True:
        if current is None:
            while at < n and not unused[at]:
                at += 1
            if at == n:
                break
            current = (at, 0)
            unused[at] = False
        d, first = current
        take = min(room, int(lengths[d]) - first)
        seq.append((d, first, take))
        room -= take
        current = (d, first + take) if first + take < lengths[d] else None
        if room == 0:
            out.append(seq)
            seq, room = [], window
            continue
        # the window has room: neighbours of its seed, until none is left or one does not fit
        seed = seq[0][0]
        q = terms[seed][np.argsort(-weights[seed], kind="stable")[:QUERY_TERMS]]
        while room and current is None:
            near = index.neighbours(q, unused, NEIGHBOURS).tolist()
            if not near:
                break
            for j in near:
                if lengths[j] <= room:
                    seq.append((j, 0, int(lengths[j])))
                    unused[j] = False
                    room -= int(lengths[j])
            left = [j for j in near if unused[j]]
            if room and left:
                current = (left[0], 0)
                unused[left[0]] = False
        if room == 0:
            out.append(seq)
            seq, room = [], window
    if seq:
        out += powers(seq)
    return out


def powers(seq: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces of a sequence cut into sequences whose lengths are falling powers of two."""
    left, out, cur, room = sum(s[2] for s in seq), [], [], 0
    for d, first, n in seq:
        while n:
            if room == 0:
                room = 1 << (left.bit_length() - 1)
            take = min(room, n)
            cur.append((d, first, take))
            first, n, room, left = first + take, n - take, room - take, left - take
            if room == 0:
                out.append(cur)
                cur = []
    return out


PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(df: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, window: int = WINDOW, shard_docs: int = SHARD_DOCS, seed: int = SEED) -> DataFrame:
    """Pieces (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all rows of df."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(DEFAULT_TOKENIZER)
    rows = stash(tokenised(df, id_col, text, tokenizer, window, seed))
    stats = statistics(rows)
    names = [c.split()[0] for c in PIECES.split(", ")]
    shared = df.sparkSession.sparkContext.broadcast(stats)

    def shard(t, seq):
        t = t.combine_chunks().sort_by([("h", "ascending"), ("id", "ascending"), ("doc_tokens", "ascending"), ("rest", "ascending")])
        ids, total = t.column("id").to_pylist(), t.column("doc_tokens").to_pylist()
        rest = [np.frombuffer(x, "<u2") for x in t.column("rest").to_pylist()]
        terms, weights = weigh(rest, shared.value)
        out = []
        for k, crcs in enumerate(t.column("whole").to_pylist()):
            for j, c in enumerate(crcs):
                out.append((ids[k], j * window, window, c, total[k], seq, 0))
                seq += 1
        for pieces in fill(np.array([len(r) for r in rest]), terms, weights, window):
            at = 0
            for d, first, n in pieces:
                out.append((ids[d], total[d] - len(rest[d]) + first, n, zlib.crc32(rest[d][first : first + n].astype("<u4").tobytes()), total[d], seq, at))
                at += n
            seq += 1
        return seq, pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names) if out else None

    def run(batches):
        from pyspark import TaskContext

        seq, held = TaskContext.get().partitionId() << 40, []
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, shard_docs - sum(b.num_rows for b in held))
                held.append(part)
                batch = batch.slice(part.num_rows)
                if sum(b.num_rows for b in held) == shard_docs:
                    seq, out = shard(pa.Table.from_batches(held), seq)
                    held = []
                    if out:
                        yield out
        if held:
            _, out = shard(pa.Table.from_batches(held), seq)
            if out:
                yield out

    ranges = max(1, -(-stats[1] // (SHARDS * shard_docs)))
    return rows.repartitionByRange(ranges, "near", "h").sortWithinPartitions("near", "h").mapInArrow(run, PIECES).withColumnRenamed("id", id_col)


def op7(spark, sf_dir: str) -> DataFrame:
    from skein.llm.common import table

    return pack(table(spark, sf_dir, "documents"), "doc_id", "text")
