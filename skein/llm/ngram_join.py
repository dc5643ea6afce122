"""Exact n-gram Jaccard join with PartEnum signatures.

Two documents link when the Jaccard similarity of their sets of distinct n-word shingles is at least num/den.

Method. Sets fall into size bands that are so wide that a partner of a set lies in its band or in a neighbouring
one; each set signs for its band and, when large enough to have partners there, for the next. Inside a band the
similarity bounds the number k of shingles in which two sets differ. The feature domain (64-bit shingle hashes) is
partitioned into n1 parts, each of them into n2 smaller ones. With k < (n1 - spare) * (k2 + 1), two similar sets
differ by k2 shingles at most in more than `spare` parts, and there at most k2 of the n2 smaller parts differ: of all
subsets of n2 - k2 smaller parts, enumerated for each part, they share at least one signature. (n1, n2, k2) are chosen
for each band by an estimate of the cost of signatures against that of unlike sets that share a passage. A subset in
which a set has nothing is signed only when more than `spare` of its parts have such a subset; that loses nothing.

One pass over the texts makes everything: sizes, content keys (128 bits of a set), parity sketches, signatures.
Sets of equal content are one class, a node. A map task sends one reference for each signature: to the class, or, where
several classes of its batch share the signature, to the `nest` of those classes, which travels once whatever the
number of signatures that they share. A signature's bucket thus holds one reference a batch at most; references and
signatures travel packed, a row for each batch and reducer. Reducers return each list of references once, however many
signatures have it. Buckets are never expanded into all pairs:
1. every member of a bucket meets the bucket's first member; after a rigorous sketch test (parities of hash cells
   differ in at most as many places as the sets do), each class keeps one such pair, which is verified exactly;
   the links give first components, which swallow groups of near copies with one pair for each member;
2. only buckets that still hold several components are looked at again: members meet in tiles of bounded size by
   the same sketch test; first, where many pairs would meet in large buckets, each member's nearest one in another
   component is verified, which merges groups of near copies without a common centre, then all pairs of different
   components that pass.
Every similar pair of different components is met in the last round, so no link between components is lost.
Whole sets are made, by another pass, only of classes in pairs that passed the sketch test. What a step has read for
the last time is deleted from the shared folder.

Defined results: null texts and texts without words have empty sets, linked with nothing, each its own component;
rows are told apart by their content, so that rows of one id and unlike texts have a component each, and only equal
sets share one; rows with a null id take no part and have a null component; ties cannot arise, as a component has the
smallest id; very long texts are hashed in spans; extra columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import words as W
from skein.llm.common import components, discard, join_components, release, ship, stash

SPARE, TILE, SMALL, SKETCH_BYTES = 4, 4096, 8, 1024
#: Members of large buckets are linked to their nearest ones first where so many pairs of them would meet.
NEAREST_FROM = 1_000_000
#: The cost estimate of (n1, n2, k2): so many texts share a passage, each this share of its shingles.
CROWD, SHARED = 100, 0.3
#: Bytes of text for each chunk of signatures, signatures packed at once, places of the id filter at most.
CHUNK_BYTES, FLUSH, FILTER_BITS = 8 << 20, 400_000, 26
#: Signatures that a member carries to tell where it has met another before.
LOWS = 8


class Bands:
    """Size bands for similarity num/den. Band i holds sizes lo[i] .. lo[i+1]-1; the next band begins where a set
    more than (den/num)^2 times as large does."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.lo = [1]
        self.shapes: dict[int, tuple[int, int, int, int]] = {}

    def reach(self, size):
        """The largest size of a partner."""
        return size * self.den // self.num

    def differ(self, a: int, b: int) -> int:
        """The largest symmetric difference of similar sets of sizes a and b."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def upto(self, size: int) -> np.ndarray:
        """The first sizes of all bands up to two beyond that of this size."""
        while self.lo[-1] <= size or len(self.lo) < 3 or self.lo[-3] <= size:
            self.lo.append(self.reach(self.reach(self.lo[-1])) + 1)
        return np.array(self.lo)

    def shape(self, band: int) -> tuple[int, int, int, int]:
        """(n1, n2, k2, spare) of a band."""
        if band not in self.shapes:
            lo, top = self.lo[band], self.lo[band + 1] - 1
            k, best = self.differ(top, top), None
            for k2 in range(min(k, 3) + 1):
                for n2 in range(k2 + 1, k2 + 4) if k2 else (1,):
                    spare = min(k, 2 if k2 else SPARE)
                    n1 = k // (k2 + 1) + 1 + spare
                    n = n1 * math.comb(n2, k2)
                    held = math.sqrt(lo * top) * (n2 - k2) / n2 / n1  # shingles under a signature
                    cost = n * (1 + CROWD * SHARED**held)
                    if best is None or cost < best[0]:
                        best = (cost, (n1, n2, k2, spare))
            self.shapes[band] = best[1]
        return self.shapes[band]


def signatures_of(values: np.ndarray, edges: np.ndarray, mixed: np.ndarray, bands: Bands, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, owners) of the sets numbered `which` among values[edges[i]:edges[i + 1]]; mixed: W.mix(values)."""
    size = np.diff(edges)
    which = which[size[which] > 0]
    if not len(which):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lo = bands.upto(int(size[which].max()))
    own = np.searchsorted(lo, size[which], "right") - 1
    higher = bands.reach(size[which]) >= lo[own + 1]
    sigs, owners = [], []
    for band in np.unique(np.concatenate((own, own[higher] + 1))).tolist():
        n1, n2, k2, spare = bands.shape(band)
        cells, kept = n1 * n2, list(combinations(range(n2), n2 - k2))
        salt = np.uint64(band * 0x9E3779B1 + 1) << np.uint64(20)
        names = (np.arange(n1 * len(kept), dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) + salt
        signing = which[(own == band) | (higher & (own == band - 1))]
        step = max(1, (1 << 20) // cells)
        for at in range(0, len(signing), step):
            docs = signing[at : at + step]
            n = size[docs]
            inside = np.repeat(edges[docs] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            place = ((values[inside] >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64) + np.repeat(np.arange(len(docs)) * cells, n)
            first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            total, full = np.zeros(len(docs) * cells, np.uint64), np.zeros(len(docs) * cells, bool)
            total[place[first]] = np.add.reduceat(mixed[inside], first)
            full[place[first]] = True
            total, full = total.reshape(len(docs), n1, n2), full.reshape(len(docs), n1, n2)
            if k2:
                total = np.stack([total[:, :, list(c)].sum(axis=2, dtype=np.uint64) for c in kept], axis=2)
                full = np.stack([full[:, :, list(c)].any(axis=2) for c in kept], axis=2)
            weak = (~full).any(axis=2).sum(axis=1) > spare
            signed = (full | weak[:, None, None]).reshape(len(docs), -1)
            sigs.append(W.mix(total.reshape(len(docs), -1) + names)[signed])
            owners.append(np.repeat(docs, signed.sum(axis=1)))
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(sigs), np.concatenate(owners)


def signatures(s: np.ndarray, bands: Bands) -> np.ndarray:
    """The signatures of one sorted distinct set of hashes."""
    return signatures_of(s, np.array([0, len(s)]), W.mix(s), bands, np.array([0]))[0]


_OTHER = np.uint64(0x5851F42D4C957F2D)


def keys_of(values: np.ndarray, edges: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    """(sets, 2): 128 bits of each set's content; zero for an empty one."""
    out = np.zeros((len(edges) - 1, 2), np.uint64)
    some = np.flatnonzero(np.diff(edges))
    if len(some):
        out[some, 0] = np.add.reduceat(mixed, edges[some])
        out[some, 1] = np.add.reduceat(W.mix(values ^ _OTHER), edges[some])
    return out


def sketch_bits(size: int) -> int:
    """Cells of a set's parity sketch: a power of two above its size, so that most cells of unlike sets differ."""
    return 1 << max(6, size.bit_length())


def sketch(s: np.ndarray) -> bytes:
    """Parities of the number of shingles in each cell."""
    n = sketch_bits(len(s))
    cells = np.bincount((s & np.uint64(n - 1)).astype(np.int64), minlength=n).astype(np.uint8) & 1
    return np.packbits(cells, bitorder="little").tobytes()


def fold(bits: np.ndarray, n: int) -> np.ndarray:
    """A sketch (bytes) brought to n cells, n a smaller power of two: parities of cells that fall together."""
    while len(bits) * 8 > n:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


SIGNATURES, NESTS, DOCS, NO_ID, SKETCHES = range(5)
PACKED = "p int, kind int, a binary, b binary, c binary"


class Packer:
    """Collects what a map task finds and packs it for the reducers, numbered 0 .. parts-1."""

    def __init__(self, parts: int, bands: Bands):
        self.parts, self.bands, self.seen, self.turn = parts, bands, set(), 0
        self.sig, self.owner, self.keys, self.rows = [], [], [], []
        self.n_sig = self.n_key = 0

    def add(self, ids: pa.Array, tags: np.ndarray, values: np.ndarray, edges: np.ndarray) -> None:
        mixed = W.mix(values)
        keys, size, known = keys_of(values, edges, mixed), np.diff(edges), ids.is_valid().to_numpy(zero_copy_only=False)
        own = ids.fill_null(0).to_numpy()
        for kind, these in ((DOCS, np.flatnonzero(known)), (NO_ID, np.flatnonzero(~known))):
            if len(these):
                self.turn += 1
                self.rows.append((self.turn % self.parts, kind, own[these].astype("<i8").tobytes(), np.stack((size[these], tags[these]), axis=1).astype("<i8").tobytes(), keys[these].tobytes()))
        new = []
        for i in np.flatnonzero(known & (size > 0)).tolist():
            key = keys[i].tobytes()
            if key not in self.seen:
                self.seen.add(key)
                new.append(i)
                self.rows.append((int(keys[i, 0] % np.uint64(self.parts)), SKETCHES, key, int(size[i]).to_bytes(8, "little"), sketch(values[edges[i] : edges[i + 1]])))
        if len(self.seen) > 1_000_000:  # bounds the memory; what comes again is only signed again
            self.seen.clear()
        sig, owner = signatures_of(values, edges, mixed, self.bands, np.array(new, np.int64))
        self.sig.append(sig)
        self.owner.append(owner + self.n_key)
        self.keys.append(keys)
        self.n_sig, self.n_key = self.n_sig + len(sig), self.n_key + len(keys)

    def flush(self):
        """Batches of PACKED."""
        if self.n_sig:
            sig, owner, keys = np.concatenate(self.sig), np.concatenate(self.owner), np.concatenate(self.keys)
            order = np.lexsort((owner, sig))
            sig, owner = sig[order], owner[order]
            first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            n = np.diff(np.append(first, len(sig)))
            ref = owner[first]
            if (n > 1).any():  # nests: the classes of this batch that share a signature
                a = np.add.reduceat(W.mix(keys[owner, 0] + np.uint64(7)), first)
                b = np.add.reduceat(W.mix(keys[owner, 1] + np.uint64(11)), first)
                nests: dict[bytes, int] = {}
                more = []
                for k in np.flatnonzero(n > 1).tolist():
                    name = a[k].tobytes() + b[k].tobytes()
                    if name not in nests:
                        nests[name] = len(keys) + len(more)
                        more.append((a[k], b[k]))
                        self.rows.append((int(a[k] % np.uint64(self.parts)), NESTS, name, b"", keys[owner[first[k] : first[k] + n[k]]].tobytes()))
                    ref[k] = nests[name]
                keys = np.concatenate((keys, np.array(more, np.uint64)))
            sig = sig[first]
            to = (sig % np.uint64(self.parts)).astype(np.int64)
            order = np.lexsort((ref, to))
            sig, ref, to = sig[order], ref[order], to[order]
            cuts = np.searchsorted(to, np.arange(self.parts + 1)).tolist()
            for p, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                if hi > lo:
                    r = ref[lo:hi]
                    new = np.concatenate(([True], r[1:] != r[:-1]))
                    self.rows.append((p, SIGNATURES, sig[lo:hi].tobytes(), np.packbits(new).tobytes(), keys[r[new]].tobytes()))  # a bit for each, set where the next key begins
        self.sig, self.owner, self.keys, self.n_sig, self.n_key = [], [], [], 0, 0
        rows, self.rows = self.rows, []
        for i in range(0, len(rows), 4096):
            p, kind, a, b, c = zip(*rows[i : i + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(kind, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(c, pa.binary())], names=["p", "kind", "a", "b", "c"])


def signed(docs: DataFrame, n: int, num: int, den: int, parts: int) -> DataFrame:
    """PACKED rows of docs (id, text, tag)."""
    ship(docs.sparkSession)

    def run(batches):
        packer = Packer(parts, Bands(num, den))
        for batch in batches:
            ids, tags = batch.column(0), batch.column(2).fill_null(0).to_numpy()
            for i, values, edges in W.text_sets(batch.column(1), n):
                m = len(edges) - 1
                packer.add(ids.slice(i, m), tags[i : i + m], values, edges)
                if packer.n_sig >= FLUSH:
                    yield from packer.flush()
        yield from packer.flush()

    return docs.select("id", "text", "tag").mapInArrow(run, PACKED)


FOUND = "kind int, a long, b long, c long, d long, e long, x binary"


def _found(kind: int, cols, x=None) -> pa.Table:
    cols = [np.ascontiguousarray(c).view(np.int64) for c in cols]
    m = len(cols[0])
    cols += [np.zeros(m, np.int64)] * (5 - len(cols))
    return pa.table([pa.array(np.full(m, kind, np.int32)), *map(pa.array, cols), pa.array(x, pa.binary()) if x else pa.nulls(m, pa.binary())], names=["kind", "a", "b", "c", "d", "e", "x"])


def lists_of(sig: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, refs), a row for each reference in each distinct list of references that share a signature."""
    order = np.argsort(sig, kind="stable")
    sig = sig[order]
    same = sig[1:] == sig[:-1]
    many = np.concatenate((same, [False])) | np.concatenate(([False], same))
    sig, refs = sig[many], refs[order[many]]
    if not len(sig):
        return np.zeros((0, 2), np.uint64), refs
    order = np.lexsort((refs[:, 1], refs[:, 0], sig))
    sig, refs = sig[order], refs[order]
    new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (refs[1:] != refs[:-1]).any(axis=1)))
    sig, refs = sig[new], refs[new]  # a class that several tasks sent
    first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    n = np.diff(np.append(first, len(sig)))
    name = np.stack([np.add.reduceat(W.mix(refs[:, k] + np.uint64(13)), first) for k in (0, 1)], axis=1)
    _, once = np.unique(name, axis=0, return_index=True)
    once = once[n[once] > 1]
    held = np.zeros(len(first), bool)
    held[once] = True
    pick = np.repeat(held, n)
    return np.repeat(name, n, axis=0)[pick], refs[pick]


def reduced(packed: DataFrame) -> DataFrame:
    """FOUND rows: lists (name 2, ref 2), nests (name 2, key 2), documents (id, size, key 2, tag), sketches (key 2, size)."""

    def run(t):
        kinds = t.column("kind").to_numpy()
        a, b, c = (t.column(x) for x in "abc")
        as_array = lambda x, kind: np.frombuffer(x.as_buffer(), kind)
        out, sigs, refs, nests = [], [], [], set()
        for i, kind in enumerate(kinds.tolist()):
            key = as_array(c[i], "<u8").reshape(-1, 2) if kind != SKETCHES else None
            if kind == SIGNATURES:
                sigs.append(as_array(a[i], "<u8"))
                refs.append(key[np.cumsum(np.unpackbits(as_array(b[i], np.uint8), count=len(sigs[-1])), dtype=np.int64) - 1])
            elif kind == NESTS:
                name = a[i].as_py()
                if name not in nests:
                    nests.add(name)
                    name = np.frombuffer(name, "<u8")
                    out.append(_found(NESTS, (np.full(len(key), name[0]), np.full(len(key), name[1]), key[:, 0], key[:, 1])))
            elif kind in (DOCS, NO_ID):
                more = as_array(b[i], "<i8").reshape(-1, 2)
                out.append(_found(kind, (as_array(a[i], "<i8"), more[:, 0], key[:, 0], key[:, 1], more[:, 1])))
        drawn = {}
        for i in np.flatnonzero(kinds == SKETCHES).tolist():
            drawn.setdefault(a[i].as_py(), i)
        if drawn:
            at = list(drawn.values())
            key = np.frombuffer(b"".join(drawn), "<u8").reshape(-1, 2)
            out.append(_found(SKETCHES, (key[:, 0], key[:, 1], np.frombuffer(b"".join(b[i].as_py() for i in at), "<i8")), [c[i].as_py() for i in at]))
        if sigs:
            name, ref = lists_of(np.concatenate(sigs), np.concatenate(refs))
            if len(name):
                out.append(_found(SIGNATURES, (name[:, 0], name[:, 1], ref[:, 0], ref[:, 1])))
        return pa.concat_tables(out) if out else _found(DOCS, [np.zeros(0, np.int64)] * 5)

    return packed.groupBy("p").applyInArrow(run, FOUND)


def whole_sets(docs: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """(h1, h2, items): whole sets (8 bytes a shingle) of these classes (rep).

    A bitmap of hashed ids goes to the tasks, which skip texts outside it, so that no text is shuffled. It has eight
    places for each class, 2^FILTER_BITS (8 MB) at most; the texts that pass by chance are in no pair and do no harm."""
    count = classes.count()
    places = 1 << min(FILTER_BITS, max(15, (8 * count).bit_length()))
    spark = docs.sparkSession
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(places))
    parts = classes.select(place("rep").alias("p")).groupBy(F.floor(F.col("p") / 32768).cast("int").alias("k")).agg(F.bitmap_construct_agg(F.pmod("p", F.lit(32768))).alias("bits"))
    whole = np.zeros(places // 8, np.uint8)
    for k, bits in parts.collect():  # 4 KB each, 2^(FILTER_BITS - 15) at most
        whole[k << 12 : (k + 1) << 12] = np.frombuffer(bits, np.uint8)
    shared = spark.sparkContext.broadcast(whole)
    ship(spark)

    def run(batches):
        held, seen = shared.value, set()
        for batch in batches:
            p = batch.column(1).to_numpy()
            got = batch.column(0).filter(pa.array((held[p >> 3] >> (p & 7) & 1).astype(bool)))
            for _, values, edges in W.text_sets(got, n):
                keys, items = keys_of(values, edges, W.mix(values)), []
                for i in range(len(edges) - 1):
                    name = keys[i].tobytes()
                    if edges[i + 1] > edges[i] and name not in seen:
                        seen.add(name)
                        items.append(i)
                if items:
                    k = keys[items].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array([values[edges[i] : edges[i + 1]].tobytes() for i in items], pa.binary())], names=["h1", "h2", "items"])

    return docs.where("id is not null").select("text", place("id").alias("p")).mapInArrow(run, "h1 long, h2 long, items binary")


def may_link(a: tuple[int, bytes], b: tuple[int, bytes], bands: Bands) -> bool:
    """False only if sets of these sizes and sketches cannot be similar."""
    (m, x), (n, y) = sorted((a, b), key=lambda v: v[0])
    if n > bands.reach(m):
        return False
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    bits = min(len(x), len(y)) * 8
    return int(np.bitwise_count(fold(x, bits) ^ fold(y, bits)).sum()) <= bands.differ(m, n)


def sketch_pairs(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sketches allow a link."""
    s = sketches.select("id", "size", "sketch")
    j = pairs.join(s.select(F.col("id").alias("a"), F.col("size").alias("m"), F.col("sketch").alias("x")), "a").join(s.select(F.col("id").alias("b"), F.col("size").alias("n"), F.col("sketch").alias("y")), "b")

    def run(batches):
        bands = Bands(num, den)
        for t in batches:
            ok = [may_link((m, x), (n, y), bands) for m, x, n, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist(), t.column(4).to_pylist(), t.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return j.select("a", "b", "m", "x", "n", "y").mapInArrow(run, "a long, b long")


class Sets:
    """Whole sets of classes, made when a pair first needs them."""

    def __init__(self, docs: DataFrame, classes: DataFrame, n: int, num: int, den: int):
        self.docs, self.classes, self.n, self.num, self.den = docs, classes, n, num, den
        self.have = self.items = None
        self.written: list[DataFrame] = []

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, by their whole sets, written."""
        need = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        if self.have is not None:
            need = need.join(self.have, "node", "left_anti")
        need = stash(self.classes.join(need, "node", "left_semi"))
        if not need.isEmpty():
            made = stash(whole_sets(self.docs, need, self.n))
            self.written += [need, made]
            have = need.select("node")
            self.have = have if self.have is None else self.have.union(have)
            self.items = made if self.items is None else self.items.union(made)
        if self.items is None:
            return pairs.limit(0)
        num, den = self.num, self.den
        c, s = self.classes.select("node", "h1", "h2"), self.items
        named = pairs.join(c.select(F.col("node").alias("b"), F.col("h1").alias("b1"), F.col("h2").alias("b2")), "b").join(c.select(F.col("node").alias("a"), "h1", "h2"), "a")
        j = named.join(s.withColumnRenamed("items", "x"), ["h1", "h2"]).select("a", "b", F.col("b1").alias("h1"), F.col("b2").alias("h2"), "x").join(s.withColumnRenamed("items", "y"), ["h1", "h2"])

        def run(batches):
            for t in batches:
                ok = []
                for x, y in zip(t.column(2), t.column(3)):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(den * both >= num * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return stash(j.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def tile_pairs(members: DataFrame, sketches: DataFrame, num: int, den: int, best: bool, tile: int = TILE) -> DataFrame:
    """Pairs of different components within the buckets that their sketches allow; with best, each member's nearest one alone.

    members: (sig, id, comp, n), n the size of the bucket. A bucket of more than `tile` members is cut into blocks by
    a hash of the id; a member goes to the tiles of its block with every block, so that a task holds two blocks at
    most. Sketches travel folded to SKETCH_BYTES. Similar members meet in many buckets: each carries its LOWS smallest
    signatures, and a pair is told only where neither shares a smaller one with the other."""
    lows = members.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("sig")), 1, LOWS).alias("low"))
    d = members.withColumn("_k", F.ceil(F.col("n") / tile).cast("int")).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_k")).cast("int"))
    d = d.select("sig", "id", "comp", "_b", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_o"))
    d = d.select("sig", F.least("_b", "_o").alias("t1"), F.greatest("_b", "_o").alias("t2"), "_b", "id", "comp").join(sketches.select("id", "size", F.col("short").alias("sketch")).join(lows, "id"), "id")
    d = d.repartition("sig", "t1", "t2").sortWithinPartitions("sig", "t1", "t2", "size", "id")

    def run(batches):
        bands = Bands(num, den)
        for t in key_runs(batches, 3):
            yield from _tile(t, bands, best)

    found = d.select("sig", "t1", "t2", "_b", "id", "comp", "size", "sketch", "low").mapInArrow(run, "a long, b long, apart long")
    if best:  # of all buckets
        found = found.groupBy("a").agg(F.min_by("b", F.struct("apart", "b")).alias("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def small_pairs(members: DataFrame) -> DataFrame:
    """All pairs of different components of buckets of SMALL members at most; pairs of several buckets come once."""

    def run(batches):
        for t in key_runs(batches, 1):
            ids, comp = t.column(1).to_numpy(), t.column(2).to_numpy()
            cuts = [0, *np.flatnonzero(_changes(t, 1)).tolist(), t.num_rows]
            a, b = [], []
            for lo, hi in zip(cuts, cuts[1:]):
                for i in range(lo, hi):
                    for j in range(i + 1, hi):
                        if comp[i] != comp[j]:
                            a.append(min(ids[i], ids[j]))
                            b.append(max(ids[i], ids[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return members.select("sig", "id", "comp").repartition("sig").sortWithinPartitions("sig").mapInArrow(run, "a long, b long").distinct()


def key_runs(batches, n_keys: int):
    """Tables of whole groups of consecutive rows with equal keys (the first n_keys columns, long or int), many to a table."""
    left = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if left is None else pa.concat_tables([left, t])
        new = np.flatnonzero(_changes(t, n_keys))
        cut = int(new[-1]) if len(new) else 0
        if cut:
            yield t.slice(0, cut).combine_chunks()
        left = t.slice(cut)
    if left is not None and left.num_rows:
        yield left.combine_chunks()


def _changes(t: pa.Table, n_keys: int) -> np.ndarray:
    out = np.zeros(t.num_rows, bool)
    for k in range(n_keys):
        x = t.column(k).to_numpy()
        out[1:] |= x[1:] != x[:-1]
    return out


def _tile(t: pa.Table, bands: Bands, best: bool):
    """Pairs of each group of (sig, t1, t2, block, id, comp, size, sketch, low), sorted by size in a group."""
    sig, t1, t2, block, ids, comp, size = (t.column(i).to_numpy() for i in range(7))
    low = low_signatures(t.column(8))
    sketches = t.column(7).to_pylist()
    cuts = [0, *np.flatnonzero(_changes(t, 3)).tolist(), t.num_rows]
    num, den, a, b, d = bands.num, bands.den, [], [], []

    def out():
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, d)], names=["a", "b", "apart"])

    for lo, hi in zip(cuts, cuts[1:]):
        if (comp[lo:hi] == comp[lo]).all():
            continue
        width = min(map(len, sketches[lo:hi])) * 8
        bits = np.stack([fold(np.frombuffer(x, np.uint8), width) for x in sketches[lo:hi]]).view(np.uint64)
        for i in range(lo, hi - 1):
            stop = lo + int(np.searchsorted(size[lo:hi], bands.reach(int(size[i])), "right"))
            if stop <= i + 1:
                continue
            z = slice(i + 1, stop)
            apart = np.bitwise_count(bits[i + 1 - lo : stop - lo] ^ bits[i - lo]).sum(axis=1, dtype=np.int64)
            near = apart <= (size[z] + size[i]) * (den - num) // (den + num)
            near &= comp[z] != comp[i]
            if t1[lo] != t2[lo]:
                near &= block[z] != block[i]
            hit = np.flatnonzero(near)
            if best and len(hit) > 1:
                hit = hit[[apart[hit].argmin()]]
            if len(hit):
                mine = low[i][low[i] < sig[i]]  # the rest of the row is filled with the largest number
                hit = hit[~(low[z][hit][:, :, None] == mine[None, None, :]).any(axis=(1, 2))]
            a += [ids[i]] * len(hit)
            b += ids[z][hit].tolist()
            d += apart[hit].tolist()
        if len(a) > 1 << 16:
            yield out()
            a, b, d = [], [], []
    if a:
        yield out()


def low_signatures(column) -> np.ndarray:
    """(rows, LOWS) of a column of sorted lists, filled up with the largest number."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    n = np.diff(lists.offsets.to_numpy())
    out = np.full((len(n), LOWS), np.iinfo(np.int64).max, np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)] = lists.flatten().to_numpy()
    return out


def ngram_join(df: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100, tag: str | None = None) -> DataFrame:
    """(id_col, n_shingles, component_id) for each row of df: shingle set size, and the smallest id reachable by links.

    tag: a long column of df that is returned besides, with group_id, a number of the component of its own: where ids
    repeat, unlinked components may have the same smallest id."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), (F.col(tag) if tag else F.lit(0)).cast("long").alias("tag"))
    parts = max(64, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // CHUNK_BYTES))
    found = stash(reduced(signed(docs, n, num, den, parts)))
    release(spark)
    # written by themselves: all else that was found is deleted long before the end
    sizes = stash(found.where(F.col("kind").isin(DOCS, NO_ID)).select(F.when(F.col("kind") == DOCS, F.col("a")).alias("id"), F.col("b").alias("n_shingles"), F.col("c").alias("h1"), F.col("d").alias("h2"), F.col("e").alias("tag")))
    # classes of equal sets; written, so that the numbers of the nodes hold
    classes = stash(sizes.where("id is not null and n_shingles > 0").groupBy("h1", "h2").agg(F.min("id").alias("rep")).withColumn("node", F.monotonically_increasing_id()))
    nests = found.where(F.col("kind") == NESTS).select(F.col("a").alias("n1"), F.col("b").alias("n2"), F.col("c").alias("k1"), F.col("d").alias("k2")).distinct()
    lists = found.where(F.col("kind") == SIGNATURES).select(F.col("a").alias("l1"), F.col("b").alias("l2"), F.col("c").alias("n1"), F.col("d").alias("n2")).distinct()
    flat = lists.join(nests, ["n1", "n2"], "left").select(F.col("l1").alias("sig"), F.coalesce("k1", "n1").alias("h1"), F.coalesce("k2", "n2").alias("h2"))
    flat = flat.union(nests.select(F.col("n1").alias("sig"), "k1", "k2"))
    members = stash(flat.join(classes, ["h1", "h2"]).select("sig", F.col("node").alias("id")).distinct())
    release(spark)
    drawn = found.where(F.col("kind") == SKETCHES).select(F.col("a").alias("h1"), F.col("b").alias("h2"), F.col("c").alias("size"), F.col("x").alias("sketch")).dropDuplicates(["h1", "h2"])
    drawn = drawn.join(classes, ["h1", "h2"]).join(members.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    sketches = stash(drawn.select(F.col("node").alias("id"), "size", "sketch").mapInArrow(_shortened, "id long, size long, sketch binary, short binary"))
    discard(found)
    release(spark)
    sets = Sets(docs, classes, n, num, den)

    hubs = members.groupBy("sig").agg(F.min("id").alias("a"))
    star = stash(members.join(hubs, "sig").where("a <> id").select("a", F.col("id").alias("b")).distinct())
    first = stash(sketch_pairs(star, sketches, num, den).groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    release(spark)
    links = sets.verify(first)
    discard(star, first)
    release(spark)
    comp = components(links)
    discard(links)
    for best in (True, False):
        release(spark)
        placed = members.select("sig", "id").join(comp, "id", "left").select("sig", "id", F.coalesce("component_id", "id").alias("comp"))
        live = placed.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("sig", "n")
        before, members = members, stash(placed.join(live, "sig"))
        discard(before)
        big = members.where(F.col("n") > SMALL)
        if best and (big.agg(F.sum("n")).first()[0] or 0) < NEAREST_FROM:
            continue
        more = tile_pairs(big, sketches, num, den, best)
        if not best:
            more = more.union(small_pairs(members.where(F.col("n") <= SMALL))).distinct()
        more = stash(more)  # the sketches that travelled to the tiles go before they travel to the pairs
        release(spark)
        tested = stash(sketch_pairs(more, sketches, num, den))
        discard(more)
        release(spark)
        links = sets.verify(tested)
        discard(tested)
        release(spark)
        if not links.isEmpty():
            before, comp = comp, join_components(comp, links)
            discard(before)
        discard(links)
    lowest = classes.join(comp.withColumnRenamed("id", "node"), "node", "left").select("h1", "h2", "rep", F.coalesce("component_id", "node").alias("comp"))
    smallest = lowest.groupBy("comp").agg(F.min("rep").alias("low"))
    named = lowest.join(smallest, "comp").select("h1", "h2", "low", "comp")
    out = sizes.join(named, ["h1", "h2"], "left")
    out = stash(out.select(F.col("id").alias(id_col), "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("low")).otherwise(F.col("id")).alias("component_id"), *([F.col("tag").alias(tag), F.when(F.col("id").isNotNull(), F.col("comp")).alias("group_id")] if tag else [])))
    discard(sizes, classes, members, sketches, comp, *sets.written)
    return out


def _shortened(batches):
    for t in batches:
        short = [fold(np.frombuffer(x, np.uint8), 8 * SKETCH_BYTES).tobytes() for x in t.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*t.columns, pa.array(short, pa.binary())], names=["id", "size", "sketch", "short"])


def op1(spark, sf_dir: str) -> DataFrame:
    from skein.llm.common import table

    return ngram_join(table(spark, sf_dir, "documents"), "doc_id", "text", n=4, num=85, den=100)


ORACLE_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select doc_id, unnest(case when len(w) >= 4 then list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w
), n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (g) where a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as id, doc_id as root from documents union select e.b, r.root from r join e on e.a = r.id),
m as (select id, min(root) as root from r group by id)
select d.doc_id, coalesce(n, 0) as n_shingles, root as component_id from documents d left join n using (doc_id) join m on m.id = d.doc_id
"""
