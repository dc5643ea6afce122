"""Words and hashes of many texts at once, on the UTF-8 bytes of an Arrow column.

A byte table says what each byte becomes (lower case) and which bytes end words; both are below 0x80, so that
working on bytes and on code points gives the same words. Everything is vectorised with numpy; slices of a few
megabytes bound the memory, whatever the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WHITE = bytes([0x20, 9, 10, 11, 12, 13])
SLICE_BYTES = 1 << 19
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = 0x9E3779B97F4A7C15
_TERM = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64 bits (constants of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    big = pa.types.is_large_string(texts.type)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64 if big else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES):
    """(first row, bytes, offsets) of consecutive rows of about `most` bytes together, one row at least."""
    if len(texts) == 0:
        return
    data, off = buffers(texts)
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(data: np.ndarray, off: np.ndarray, stops: bytes = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and for each text the number of words before it (len(off) values)."""
    table = np.ones(256, bool)
    table[list(stops)] = False
    isw = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    first = isw.copy()
    first[1:] &= ~isw[:-1] | edge[1:-1]
    starts = np.flatnonzero(first)
    last = isw.copy()
    last[:-1] &= ~isw[1:] | edge[1:-1]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
        k += m
    return out


#: Words are hashed over so many bytes at once.
_SPAN = 1 << 19
_POWER, _INVERSE = _powers(_PLACE, _SPAN), _powers(pow(_PLACE, -1, 1 << 64), _SPAN)
_VALUE = _BYTE[LOWER]


def _long_word(data: np.ndarray) -> int:
    total = 0
    for a in range(0, len(data), _SPAN):
        x = data[a : a + _SPAN]
        total += int((_VALUE[x] * _POWER[: len(x)]).sum(dtype=np.uint64)) * pow(_PLACE, a, 1 << 64)
    return total % (1 << 64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes in lower case: a random value a byte times a power of an odd number by its
    place, summed modulo 2^64 (from running sums, moved back to place 0 by the inverse power), and mixed."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        if ends[i] - base > _SPAN:
            out[i] = np.uint64(_long_word(data[base : ends[i]]))
            i += 1
            continue
        j = int(np.searchsorted(ends, base + _SPAN, "right"))
        x = _VALUE[data[base : ends[j - 1]]]
        x *= _POWER[: len(x)]
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x, out=total[1:])
        at = starts[i:j] - base
        out[i:j] = (total[ends[i:j] - base] - total[at]) * _INVERSE[at]
        i = j
    return mix(out + (ends - starts).astype(np.uint64))


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, edges): each text's sorted distinct hashes of n consecutive words, one text after the other; with fewer
    words, the hash of all of them as one."""
    total = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        total += hashes[k : k + len(total)] * _TERM[k]
    total = mix(total + np.uint64(n))
    words = np.diff(bounds)
    count = np.where(words >= n, words - n + 1, (words > 0).astype(words.dtype))
    edges = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros(int(edges[-1]), np.uint64)
    for a, m, to, c in zip(bounds[:-1].tolist(), words.tolist(), edges[:-1].tolist(), count.tolist()):
        if m >= n:
            out[to : to + c] = np.sort(total[a : a + c])
        elif m:
            out[to] = mix(np.array([(hashes[a : a + m] * _TERM[:m]).sum(dtype=np.uint64) + np.uint64(m)], np.uint64))[0]
    if not len(out):
        return out, edges
    new = np.concatenate(([True], out[1:] != out[:-1]))
    new[edges[:-1][count > 0]] = True
    return out[new], np.concatenate(([0], np.cumsum(new)))[edges]


def text_sets(texts: pa.Array, n: int):
    """Yields (first row, values, edges) for slices of texts: their shingle sets, as shingle_sets gives them."""
    for i, data, off in slices(texts):
        starts, ends, bounds = word_spans(data, off)
        yield i, *shingle_sets(word_hashes(data, starts, ends), bounds, n)
