"""Vectorised text kernels shared by the operators: words, rolling hashes, window minima, all on whole Arrow batches.

A batch of texts is one byte buffer plus offsets.  Work runs in slices of whole texts of about ``SLICE`` bytes, so the
memory of a task does not depend on how many rows a batch has (a single longer text makes a longer slice).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SLICE = 400_000
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads close values."""
    with np.errstate(over="ignore"):
        z = x.astype(U64) + U64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
        return z ^ (z >> U64(31))


def mix(h: np.ndarray) -> np.ndarray:
    """A cheaper finaliser for values that are already spread over 64 bits."""
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


#: A value for each byte.
BYTE_VALUE = splitmix(np.arange(256))
_fold = np.arange(256)
_fold[65:91] += 32
LOWER = _fold.astype(np.uint8)
#: Bytes of words made of ASCII letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of words split at white space (blank and 0x09 to 0x0D).
NONSPACE = np.ones(256, bool)
NONSPACE[9:14] = NONSPACE[32] = False

_pow = np.ones(1, U64)
_inv = np.ones(1, U64)
_BASE_INV = pow(_BASE, -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i below n; kept for the worker's lifetime."""
    global _pow, _inv
    if len(_pow) < n:
        n = max(n, SLICE + SLICE // 4)
        with np.errstate(over="ignore"):
            _pow, _inv = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, b, U64)])) for b in (_BASE, _BASE_INV))
    return _pow, _inv


def buffer_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (from 0) of a string or binary column; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if off is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, o - o[0]


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``size`` bytes, at least one text each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


@dataclass
class Words:
    """Words of a slice: byte ranges, hashes, and ``off`` (the range of words of each text)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    off: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))


def words(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray = ALNUM, hashed: bool = True) -> Words:
    """Words (maximal runs of bytes of ``kind``) of the texts of a slice; hashes are of the lower-cased (A-Z) bytes, see :func:`word_hash`."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(0, U64), np.zeros(len(offsets), np.int64))
    w = kind[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, w[:-1]
    start = np.flatnonzero(w & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, w[1:]
    end = np.flatnonzero(w & (~after | edge[1:])) + 1
    off = np.searchsorted(start, offsets)
    h = word_hash(LOWER[buf], start, end) if hashed else np.zeros(0, U64)
    return Words(start, end, h, off)


#: Masks of the first n bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def word_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words: different for different words of up to 8 bytes (their bytes are the number that is spread), else 64 bits of BLAKE2b,
    for which no texts that collide are known or can be built by a rule, as they can for sums of powers modulo 2**64.
    """
    size = end - start
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    h = splitmix(eight[start] & _FIRST[np.minimum(size, 8)])
    long = size > 8
    if len(size):
        long |= buf[np.maximum(end - 1, 0)] == 0  # a last byte of zero would be taken for none
    at = np.flatnonzero(long)
    if len(at):
        data = buf.tobytes()
        h[at] = np.frombuffer(b"".join([blake2b(data[a:b], digest_size=8).digest() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]), U64)
    return h


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of short spans of a sequence of 64-bit values (hashes of words), from prefix sums; equal content gives equal hashes anywhere.

    For long spans of few values there are spans that collide for every base (Thue-Morse sequences from 512 values on); words have hashes of their own.
    """
    p, inv = powers(len(values) + 1)
    with np.errstate(over="ignore"):
        c = np.empty(len(values) + 1, U64)
        c[0] = 0
        np.cumsum(values * p[: len(values)], out=c[1:])
        return mix((c[end] - c[start]) * inv[start] + (end - start).astype(U64))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive values, for each start (the last k-1 starts have none)."""
    if len(h) < k:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        g = np.zeros(len(h) - k + 1, U64)
        for j in range(k):
            g *= U64(_BASE)
            g += h[j : len(h) - k + 1 + j]
        return mix(g + U64(k))


def slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over each window of w values, by doubling; len(x)-w+1 results."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = op(out[:-step], out[step:])
        have += step
    return out


def minima(h: np.ndarray, off: np.ndarray, w: int) -> np.ndarray:
    """True where a value is the least of some window of w values inside its own text (all ties count).

    The choice depends on the window's content only, so two texts that share a window choose the same places in it.
    ``off``: the range of values of each text in ``h``.
    """
    chosen = np.zeros(len(h), bool)
    if len(h) < w:
        return chosen
    least = slide(h, w, np.minimum)
    ok = np.zeros(len(h) + 1, np.int32)  # windows that stay inside a text
    lens = np.diff(off)
    long = lens >= w
    np.add.at(ok, off[:-1][long], 1)
    np.add.at(ok, off[:-1][long] + (lens[long] - w + 1), -1)
    least = np.where(np.cumsum(ok)[: len(least)] > 0, least, U64(0))
    pad = np.zeros(w - 1, h.dtype)
    most = slide(np.concatenate([pad, least, pad]), w, np.maximum)
    return (most == h) & (h > 0)


def ordered(major: np.ndarray, *minor: np.ndarray) -> np.ndarray:
    """An order by several columns, the first the most important, for columns whose first rarely ties.

    The first is sorted alone (fast for 64-bit numbers), then the rows of its ties by all columns.
    """
    order = np.argsort(major)
    s = major[order]
    same = s[1:] == s[:-1]
    if same.any():
        tied = np.zeros(len(s), bool)
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        sub = order[at]
        order[at] = sub[np.lexsort((*(c[sub] for c in minor[::-1]), major[sub]))]
    return order


def expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i]+1, ... count[i] values each, concatenated."""
    total = int(count.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    first = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return first + np.arange(total)
