"""Byte-pair encoding of many words at once, equal to the tokenizers library on the words that it takes.

It reads a tokenizer file whose model is BPE with an end-of-word suffix, over byte-level characters, behind
NFC, white-space folding and lower-casing, and a split into contractions, letters, single digits and the rest.
Texts of printable ASCII, white space and Latin-1 letters are split here, on the bytes of many texts at once, and their
new pieces encoded together, one merge a piece and round, by numpy. In other texts that holds word by word; words with any other character,
and whatever might hold a special token, go through the library itself. Pieces and words are cached.
"""

from __future__ import annotations

import json
import re

import numpy as np

from skein.llm.words import LOWER, word_hashes

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\x20\t-\ra-zß-öø-ÿ0-9]+")
_PLAIN = re.compile(r"[\x20-~\t-\rÀ-ÖØ-öø-ÿ]*")
_NONE = 0xFFFF
#: Pieces kept, some 30 bytes each.
CACHE = 1_000_000
#: Longer pieces, in bytes, go through the library, whose time does not grow with the square of a piece.
LONGEST = 256


class Encoder:
    """encode(texts) gives the ids of each text, as bytes, two to an id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        if self.tok.get_vocab_size() >= _NONE:
            raise ValueError("ids of this tokenizer do not fit in two bytes")
        self.cache: dict[str, bytes] = {}
        # of plain pieces: hashes, sorted; where the ids of each begin in flat, and how many they are
        self.names, self.place, self.flat = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64), np.zeros(0, np.uint16)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], json.dumps(spec.get("pre_tokenizer") or {})
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.known = model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and kinds == ["NFC", "Replace", "Lowercase"] and json.dumps(SPLIT)[1:-1] in pre and len(model["merges"]) < _NONE
        if self.known:
            self._load(model)

    def _load(self, model: dict) -> None:
        vocab, pairs, made = model["vocab"], [], []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            pairs.append(vocab[a] << 32 | vocab[b])
            made.append(vocab[a + b])
        pairs, made = np.array(pairs, np.int64), np.array(made, np.uint16)
        rank = np.arange(len(pairs), dtype=np.uint16)
        # open hashing: `ways` slots a row, rows of equal hash in consecutive slots
        self.bits, self.ways = 18, 1
        h = self._hash(pairs)
        order = np.argsort(h, kind="stable")
        place = np.arange(len(h)) - np.searchsorted(h[order], h[order])
        self.ways = int(place.max()) + 1
        self.key = np.full((self.ways, 1 << self.bits), -1, np.int64)
        self.val = np.full((self.ways, 1 << self.bits), _NONE, np.uint16)
        self.key[place, h[order]], self.val[place, h[order]] = pairs[order], rank[order]
        self.made = made
        # the byte-level alphabet: printable Latin-1 bytes are themselves, the others follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char, extra = {b: chr(b) for b in plain}, 0
        for b in range(256):
            if b not in char:
                char[b] = chr(256 + extra)
                extra += 1
        self.first = np.array([vocab[char[b]] for b in range(256)], np.uint16)
        self.last = np.array([vocab[char[b] + "</w>"] for b in range(256)], np.uint16)

    def _hash(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a.astype(np.int64) << 32 | b
        h = self._hash(pair)
        out = np.full(len(pair), _NONE, np.uint16)
        for w in range(self.ways):
            hit = self.key[w, h] == pair
            out[hit] = self.val[w, h[hit]]
        return out

    def pieces(self, parts: list[bytes]) -> list[bytes]:
        """Ids of each piece (bytes, not empty), two bytes to an id."""
        out: list = [None] * len(parts)
        size = np.array([len(p) for p in parts])
        for i in np.flatnonzero(size > LONGEST).tolist():
            out[i] = np.array(self.tok.encode(parts[i].decode(), add_special_tokens=False).ids, np.uint16).tobytes()
        order = np.argsort(size, kind="stable")[: int((size <= LONGEST).sum())]
        cuts = [0, *(int(np.searchsorted(size[order], x, "right")) for x in (6, 10, 16, 32, 64)), len(order)]
        for lo, hi in zip(cuts, cuts[1:]):
            for at in range(lo, hi, 1 << 15):
                self._together(parts, order[at : min(hi, at + (1 << 15))], size, out)
        return out

    def _together(self, parts, which, size, out) -> None:
        if not len(which):
            return
        n, wide = size[which], int(size[which].max())
        s = np.full((len(which), wide), _NONE, np.uint16)
        data = np.frombuffer(b"".join([parts[i] for i in which.tolist()]), np.uint8)
        row = np.repeat(np.arange(len(which)), n)
        col = np.arange(len(data)) - np.repeat(np.cumsum(n) - n, n)
        s[row, col] = self.first[data]
        end = np.cumsum(n) - 1
        s[np.arange(len(which)), n - 1] = self.last[data[end]]
        r = np.full((len(which), wide), _NONE, np.uint16)
        inner = col < n[row] - 1
        r[row[inner], col[inner]] = self._rank(s[row[inner], col[inner]], s[row[inner], col[inner] + 1])
        live, cols = np.arange(len(which)), np.arange(wide)
        while True:
            j = r.argmin(axis=1)
            best = r[np.arange(len(j)), j]
            done = best == _NONE
            if done.any():
                ready = s[done]
                held = ready != _NONE
                flat, cut = ready[held].tobytes(), np.concatenate(([0], np.cumsum(held.sum(axis=1)) * 2)).tolist()
                for k, a, b in zip(which[live[done]].tolist(), cut, cut[1:]):
                    out[k] = flat[a:b]
                keep = ~done
                s, r, j, best, live = s[keep], r[keep], j[keep], best[keep], live[keep]
            if not len(live):
                return
            rows = np.arange(len(live))
            right = cols[None, :] > j[:, None]
            s[:, :-1] = np.where(right[:, :-1], s[:, 1:], s[:, :-1])
            r[:, :-1] = np.where(right[:, :-1], r[:, 1:], r[:, :-1])
            s[:, -1], r[:, -1] = _NONE, _NONE
            s[rows, j] = self.made[best]
            r[rows, j] = _NONE
            nxt = np.minimum(j + 1, wide - 1)
            ok = (j + 1 < wide) & (s[rows, nxt] != _NONE)
            r[rows[ok], j[ok]] = self._rank(s[rows[ok], j[ok]], s[rows[ok], nxt[ok]])
            ok = j > 0
            r[rows[ok], j[ok] - 1] = self._rank(s[rows[ok], j[ok] - 1], s[rows[ok], j[ok]])

    def _split(self, text: str) -> list[str]:
        """Pieces of a text that is not plain, in order, and whole words after a blank where the library must see them."""
        if not self.known or any(t in text for t in self.special):
            return [" " + text]
        out = []
        for w in re.split(r"[\x20\t-\r]+", text):
            if w:
                out += _PIECES.findall(w.lower()) if _PLAIN.fullmatch(w) else [" " + w]
        return out

    def _others(self, texts: list[str]) -> list[bytes]:
        split = [self._split(t) for t in texts]
        cache = self.cache
        new = set().union(*split).difference(cache)
        if len(cache) + len(new) > CACHE // 8:
            cache.clear()
            new = set().union(*split)
        own, lib = [k for k in new if k[0] != " "], [k for k in new if k[0] == " "]
        cache.update(zip(own, self.pieces([k.encode() for k in own])))
        for k, e in zip(lib, self.tok.encode_batch([k[1:] for k in lib], add_special_tokens=False)):
            cache[k] = np.array(e.ids, np.uint16).tobytes()
        return [b"".join([cache[k] for k in ks]) for ks in split]

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        """Ids of plain texts: pieces are told apart by a 64-bit hash, and each is encoded once."""
        off = np.cumsum([0, *map(len, texts)])
        data = np.frombuffer(b"".join(texts), np.uint8)
        data, starts, ends = cut(data, off)
        if not len(starts):
            return [b""] * len(texts)
        hashes, which = np.unique(word_hashes(data, starts, ends), return_inverse=True)
        if len(self.names) + len(hashes) > CACHE:
            self.names, self.place = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
            self.flat = np.zeros(0, np.uint16)
        at = np.searchsorted(self.names, hashes)
        new = np.flatnonzero((at == len(self.names)) | (np.append(self.names, 0)[at] != hashes))
        if len(new):
            some = np.zeros(len(hashes), np.int64)
            some[which] = np.arange(len(which))
            whole = data.tobytes()
            ids = self.pieces([whole[a:b] for a, b in zip(starts[some[new]].tolist(), ends[some[new]].tolist())])
            n = np.array([len(x) for x in ids]) // 2
            place = np.stack((len(self.flat) + np.cumsum(n) - n, n), axis=1)
            self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(ids), np.uint16)))
            self.names, self.place = np.insert(self.names, at[new], hashes[new]), np.insert(self.place, at[new], place, axis=0)
            at = np.searchsorted(self.names, hashes)
        first, n = self.place[at[which]].T
        total = np.cumsum(n)
        out = self.flat[np.repeat(first - total + n, n) + np.arange(int(total[-1]))].tobytes()
        edges = (2 * np.append(0, total)[np.searchsorted(starts, off)]).tolist()
        return [out[a:b] for a, b in zip(edges, edges[1:])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        plain = [bool(self.known and _PLAIN.fullmatch(t)) and not any(x in t for x in self.special) for t in texts]
        fast = iter(self._plain([t.encode() for t, p in zip(texts, plain) if p]))
        slow = iter(self._others([t for t, p in zip(texts, plain) if not p]))
        return [next(fast if p else slow) for p in plain]


# classes of bytes: 0 white space, 1 letters (and the bytes of Latin-1 letters), 2 digits, 3 the rest
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_QUOTE, _ONE, _TWO = ord("'"), np.isin(np.arange(256), list(b"stmd")), [b"re", b"ve", b"ll"]


def cut(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case bytes, starts, ends) of the pieces of plain texts that begin at off: runs of letters, single digits,
    runs of the rest, and contractions after an apostrophe that stands alone."""
    low = LOWER[data]
    high = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0x9F)) + 1 if len(data) else np.zeros(0, np.int64)
    low[high] += 0x20
    kind = _CLASS[data]
    text = np.zeros(len(data) + 1, bool)
    text[off] = True
    begins = np.ones(len(data), bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2) | text[1:-1]
    ends = np.append(begins[1:], True)
    quote = np.flatnonzero((low == _QUOTE) & begins & ends)
    if len(quote):
        pad = np.append(low, [0, 0, 0])
        edge = np.append(text, [True, True])
        one = _ONE[pad[quote + 1]] & ~edge[quote + 1]
        two = np.zeros(len(quote), bool)
        for x, y in _TWO:
            two |= (pad[quote + 1] == x) & (pad[quote + 2] == y)
        two &= ~edge[quote + 1] & ~edge[quote + 2]
        for q, n in ((quote[one], 1), (quote[two], 2)):
            begins[q + 1] = False
            after = q + n + 1
            after = after[after < len(data)]
            begins[after] = True  # what follows begins a piece in any case
    starts = np.flatnonzero(begins)
    stops = np.append(starts[1:], len(data))
    full = kind[starts] != 0
    return low, starts[full], stops[full]
