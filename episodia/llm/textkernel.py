"""Vectorised text primitives that run inside Arrow batches.

Everything works on the UTF-8 bytes of a whole batch at once, so the cost per
document is a few array passes and no Python loop over words.  A word is
``[^\\x20\\x09-\\x0D]+``; a null text counts as empty.

Words, lines and other ranges have 64-bit hashes of non-linear rounds over
eight bytes each (``range_hash``; long ranges: BLAKE2b).  ``Prefix`` is a
polynomial modulo 2**64, which patterns of doubling length defeat: it only
chooses places and never decides that two ranges are equal.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(20240229)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 2**64)
SLICE_BYTES = 1 << 20
LONG_RANGE = 256  # bytes; longer ranges are hashed one by one


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, BASE_INVERSE):
        p = np.full(1 << bits, U64(base))
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; callers pass pieces of bounded size."""
    return _powers(max(16, int(n).bit_length()))


def range_hash(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges."""
    size = end - begin
    h = mix(size.astype(np.uint64) + U64(0x6A09E667F3BCC909))
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    live, k = np.flatnonzero((size > 0) & (size <= LONG_RANGE)), 0
    while len(live):
        left = size[live] - k
        w = eight[begin[live] + k]
        tail = np.flatnonzero(left < 8)
        w[tail] &= (U64(1) << (left[tail].astype(np.uint64) * U64(8))) - U64(1)
        h[live] = mix((h[live] ^ w) * U64(0xD6E8FEB86659FD93) + U64(0x3C6EF372FE94F82B))
        live, k = live[left > 8], k + 8
    view = memoryview(padded)
    for i in np.flatnonzero(size > LONG_RANGE).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(view[begin[i] : end[i]], digest_size=8).digest(), "little")
    return h


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a string array with the start and end of each text; nulls are empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    at = at - at[0] if len(at) else np.zeros(1, np.int64)
    return raw, at[:-1], at[1:]


def release() -> None:
    """Give freed memory back: workers are used again by later stages and would keep what the largest one took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``limit`` bytes of text (one text is never cut)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, _, ends = buffers(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
    release()


class Prefix:
    """Polynomial prefix hashes: the hash of any byte range in O(1), for choosing places only."""

    def __init__(self, raw: np.ndarray):
        p, self.inverse = powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[raw] * p[: len(raw)], dtype=np.uint64, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]


def spans(inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` that do not cross a text's limits."""
    full = ends > starts
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    before[starts[full]] = False
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    after[ends[full] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def owner(at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Index of the text that holds each byte position."""
    return np.searchsorted(starts, at, "right") - 1


class Words:
    """Words of a batch: their ranges, owning text, and 64-bit hashes."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False):
        self.raw = LOWER[raw] if lower else raw
        self.begin, self.end = spans(~SPACE[self.raw], starts, ends)
        self.doc = owner(self.begin, starts)
        self.count = np.bincount(self.doc, minlength=len(starts))
        self.hash = range_hash(self.raw, self.begin, self.end)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First-word index and hash of every run of ``n`` words inside one text."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        ok = self.doc[:m] == self.doc[n - 1 :]
        h = np.zeros(m, np.uint64)
        for k in range(n):
            h = h * U64(0xD6E8FEB86659FD93) + self.hash[k : k + m]
        at = np.flatnonzero(ok)
        return at, mix(h[at])


def same(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    order = np.argsort(keys)
    k = keys[order]
    twin = np.zeros(len(k) + 1, bool)
    twin[1:-1] = k[1:] == k[:-1]
    out = np.zeros(len(k), bool)
    out[order[twin[1:] | twin[:-1]]] = True
    return out


def sorted_unique(value: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and their offsets; ``doc`` ascends."""
    at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n_docs))])
    value = value.copy()
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        if hi - lo > 1:
            value[lo:hi].sort()
    keep = np.ones(len(value), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return value[keep], np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=n_docs))]).astype(np.int64)


def shingle_sets(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct lower-cased n-word shingles per text, as sorted 64-bit hashes with offsets.

    A text of fewer than ``n`` words has its whole word sequence as its one
    shingle; a text without words has none.
    """
    w = Words(raw, starts, ends, lower=True)
    at, h = w.windows(n)
    doc = w.doc[at]
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    if len(short):
        first = np.concatenate([[0], np.cumsum(w.count)])
        whole = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = w.count[short] > k
            whole[has] = whole[has] * U64(0xD6E8FEB86659FD93) + w.hash[first[short[has]] + k]
        doc = np.concatenate([doc, short])
        h = np.concatenate([h, mix(whole ^ (w.count[short].astype(np.uint64) << U64(56)))])
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    return sorted_unique(h, doc, len(starts))
