"""Vectorised words, n-gram hashes and selections over Arrow string columns.

Texts are read as the UTF-8 bytes of an Arrow column, a few megabytes at a
time, so memory does not depend on how long a batch is (one very long text is
one block of its own).

A word's hash chains a non-linear 64-bit mixer over its bytes, eight at a time;
a word of over ``INLINE`` bytes is hashed by BLAKE2.  An n-gram's hash is a
balanced tree over its words' hashes, each node mixed again, so no sum or
polynomial of the words is left that structured texts could make equal.  Lanes
0 and 1 start from different seeds and are used together where 64 bits would
not do.  The mixer has no key: it is made against accidents, not against an
adversary.  All constants are fixed, so every executor and every retry gets the
same hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK_BYTES = 1 << 20

#: Words of other characters than space and U+0009 to U+000D.
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
#: Words of digits, ASCII letters and everything above U+007F.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(29)
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(32)
    return x


#: A range of up to so many bytes is mixed eight bytes at a time, a longer one goes to BLAKE2.
INLINE = 64
SEEDS = (U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB))
_FACTORS = (U64(0xD6E8FEB86659FD93), U64(0xC2B2AE3D27D4EB4F))
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of ``data``, and from its end, as numbers; zeros follow the last byte."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def byte_hashes(data: np.ndarray, view: np.ndarray, lo: np.ndarray, hi: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hash of data[lo:hi] for each pair; ``view`` is ``eights(data)``."""
    size = hi - lo
    out = mix(size.astype(U64) + SEEDS[lane])
    out = mix(out ^ (view[lo] & _MASK[np.minimum(size, 8)]))
    at, done = np.flatnonzero((size > 8) & (size <= INLINE)), 8
    while len(at):
        left = size[at] - done
        out[at] = mix(out[at] ^ (view[lo[at] + done] & _MASK[np.minimum(left, 8)]))
        at = at[left > 8]
        done += 8
    for i in np.flatnonzero(size > INLINE).tolist():
        digest = hashlib.blake2b(data[lo[i] : hi[i]].tobytes(), digest_size=16).digest()
        out[i] = np.frombuffer(digest, "<u8")[lane]
    return out


def same_bytes(one: np.ndarray, a: np.ndarray, other: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes from a in one array are those from b in the other, for each triple; both arrays as ``eights``."""
    out = np.ones(len(size), bool)
    at, done = np.flatnonzero(size > 0), 0
    while len(at):
        left = size[at] - done
        equal = (one[a[at] + done] ^ other[b[at] + done]) & _MASK[np.minimum(left, 8)] == 0
        out[at[~equal]] = False
        at = at[equal & (left > 8)]
        done += 8
    return out


def join(a: np.ndarray, b: np.ndarray, lane: int) -> np.ndarray:
    """Hash of two runs side by side from their hashes."""
    return mix(a * _FACTORS[lane] + ((b << U64(23)) | (b >> U64(41))))


def _doubled(x: np.ndarray, lane: int) -> np.ndarray:
    """Tree over the columns, a power of two of them."""
    while x.shape[1] > 1:
        x = join(x[:, 0::2], x[:, 1::2], lane)
    return x[:, 0]


class Block:
    """Some whole texts: ``first`` is the row of the first, ``off[i]:off[i+1]`` are the words of the i-th."""

    def __init__(self, first: int, data: np.ndarray, ends: np.ndarray, keep: np.ndarray, fold: bool):
        self.first, self.n, self.data, self.fold = first, len(ends) - 1, data, fold
        inside = keep[data]
        before = np.empty_like(inside)
        if len(data):
            before[0] = False
            before[1:] = inside[:-1]
            bounds = ends[:-1][ends[:-1] < len(data)]
            before[bounds] = False
            after = np.empty_like(inside)
            after[-1] = False
            after[:-1] = inside[1:]
            cut = ends[1:]
            after[cut[cut > 0] - 1] = False
            self.lo = np.flatnonzero(inside & ~before)
            self.hi = np.flatnonzero(inside & ~after) + 1
        else:
            self.lo = self.hi = np.zeros(0, np.int64)
        self.off = np.searchsorted(self.lo, ends)
        self._own = FOLD[data] if fold else data
        self._view = eights(self._own)
        self._runs: dict = {}  # (lane, b): hashes of the 2**b words from each position

    def words(self, lane: int = 0) -> np.ndarray:
        return self._run(lane, 0)

    def _run(self, lane: int, b: int) -> np.ndarray:
        if (lane, b) not in self._runs:
            if b:
                half = self._run(lane, b - 1)
                width = 1 << (b - 1)
                new = join(half[:-width], half[width:], lane) if len(half) > width else half[:0]
            else:
                new = byte_hashes(self._own, self._view, self.lo, self.hi, lane)
            self._runs[lane, b] = new
        return self._runs[lane, b]

    def _some(self, lane: int, i: np.ndarray) -> np.ndarray:
        if (lane, 0) in self._runs:
            return self._runs[lane, 0][i]
        own, back = np.unique(i, return_inverse=True)
        return byte_hashes(self._own, self._view, self.lo[own], self.hi[own], lane)[back].reshape(i.shape)

    def grams(self, k: int, lane: int = 0, at: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the k words from each position (or those in ``at``); positions too near the block's end are left out."""
        n = max(0, len(self.lo) - k + 1)
        bits = [b for b in range(k.bit_length() - 1, -1, -1) if k >> b & 1]
        if at is not None and len(at) * k < n:
            words, done, out = self._some(lane, at[:, None] + np.arange(k)), 0, None
            for b in bits:
                part = _doubled(words[:, done : done + (1 << b)], lane)
                out = part if out is None else join(out, part, lane)
                done += 1 << b
            return out
        if not n:
            return np.zeros(0, U64)
        out, done = self._run(lane, bits[0])[:n], 1 << bits[0]
        for b in bits[1:]:
            out = join(out, self._run(lane, b)[done : done + n], lane)
            done += 1 << b
        return out if at is None else out[at]

    def room(self) -> np.ndarray:
        """For each word, how many words its text has from there on."""
        n = np.diff(self.off)
        return np.repeat(self.off[1:], n) - np.arange(self.off[0], self.off[-1]) if len(n) else np.zeros(0, np.int64)

    def whole(self, lane: int) -> np.ndarray:
        """Hash of each text's whole word sequence: a tree over its words, and their number."""
        now, size = self.words(lane), np.diff(self.off)
        start, n = self.off[:-1], size
        while len(n) and n.max() > 1:
            fewer = (n + 1) // 2
            to = np.cumsum(fewer) - fewer
            left = np.repeat(start - 2 * to, fewer) + 2 * np.arange(fewer.sum())
            paired = left + 1 < np.repeat(start + n, fewer)
            after = now[left]
            after[paired] = join(after[paired], now[left[paired] + 1], lane)
            now, start, n = after, to, fewer
        out = size.astype(U64) + SEEDS[lane]
        full = size > 0
        out[full] = join(out[full], now[start[full]], lane)
        return mix(out)


def raw_blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, ends) of whole texts of a string column (null: empty), about ``most`` bytes at a time."""
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        b = min(b, n)
        yield raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
        a = b


def blocks(column: pa.Array, keep: np.ndarray, fold: bool = False, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a string column (null: empty) as blocks of about ``most`` bytes."""
    first = 0
    for data, ends in raw_blocks(column, most):
        yield Block(first, data, ends, keep, fold)
        first += len(ends) - 1


def winnow(grams: np.ndarray, width: int, ok: np.ndarray) -> np.ndarray:
    """Positions that hold the leftmost minimum of some window of ``width`` consecutive grams.

    ``ok[i]`` says that the window that starts at i lies within one text.
    """
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = grams
    done = 1
    while done < width:  # minimum over 2, 4, ... grams, then over width
        step = min(done, width - done)
        low = np.minimum(low[:-step], low[step:])
        done += step
    starts = np.flatnonzero(ok[:n])
    if not len(starts):
        return starts
    # the minimum of a window is that of the last window, or stands at its end, unless the last one's minimum has gone
    same = np.zeros(len(grams), bool)
    values = low[starts]
    for d in range(width):
        hit = grams[starts + d] == values
        same[starts[hit] + d] = True
        starts, values = starts[~hit], values[~hit]
        if not len(starts):
            break
    return np.flatnonzero(same)


def lookup(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value in a sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(values), -1)
    if len(values) > 256 and len(table) > 4096:  # in order, so that a large table is walked through once
        order = np.argsort(values)
        i = np.empty(len(values), np.int64)
        i[order] = np.searchsorted(table, values[order])
    else:
        i = np.searchsorted(table, values)
    i[i == len(table)] = 0
    return np.where(table[i] == values, i, -1)
