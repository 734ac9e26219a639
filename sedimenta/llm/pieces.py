"""Cutting texts where a tokenizer cuts them in any case, and remembering what each piece gives.

With the byte-level pattern, and with every tokenizer that drops white space, a
single space between two other characters that are not white space begins a new
pre-token.  So a text may be cut before each such space, pieces encoded one by
one and the results put together; most pieces recur.  What a piece gives is
looked up by a hash of its bytes and taken only if the bytes agree too.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from sedimenta.llm.wordhash import INLINE, U64, byte_hashes, eights, lookup, raw_blocks, same_bytes

#: Pieces that a worker remembers at most (about 35 MB).
REMEMBERED = 1_000_000

_AMBIGUOUS = re.compile(r" \s|\s ")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def pieces(text: str) -> list[str]:
    """The text's pieces without the space that each but the first begins with."""
    return _CUT.split(text) if _AMBIGUOUS.search(text) else text.split(" ")


class Remembered(dict):
    """A function of a string with a bounded memory of two generations.

    When the younger one is full it becomes the older, and that is forgotten;
    what is used again meanwhile moves to the younger.
    """

    def __init__(self, make: Callable, most: int = 250_000):
        self.make, self.half, self.older = make, most // 2, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > 64:
                return value
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), *range(28, 33)]] = True


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Places of the spaces in UTF-8 bytes that stand between two characters which are not white space."""
    at = np.flatnonzero(data == 32)
    at = at[(at > 0) & (at < len(data) - 1)]
    padded = np.concatenate([np.zeros(3, np.uint8), data, np.zeros(3, np.uint8)])
    one, two, three = padded[at + 2], padded[at + 1], padded[at]
    good = ~_SPACE[one] & ~((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) & ~_wide(three, two)
    one, two = padded[at + 4], padded[at + 5]
    good &= ~_SPACE[one] & ~((one == 0xC2) & ((two == 0x85) | (two == 0xA0))) & ~_wide(one, two)
    return at[good]


def _wide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a three-byte character that begins so may be white space."""
    return ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80))


class _Growing:
    """An array that is added to; eight zeros at least follow what it holds."""

    def __init__(self, kind: str):
        self.data, self.n = np.zeros(1 << 12, kind), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) + 8 > len(self.data):
            more = np.zeros(max(self.n + len(x) + 8, len(self.data) * 3 // 2), self.data.dtype)
            more[: self.n] = self.data[: self.n]
            self.data = more
        self.data[self.n : self.n + len(x)] = x
        self.n += len(x)


class PieceIds:
    """Ids of whole texts by pieces.

    ``make`` gives the ids of pieces that are not remembered, which are up to
    ``most`` of at most INLINE bytes; a piece is told by its bytes, which are
    found by their hash and compared.  Texts that hold one of ``special`` are
    one piece.  With ``end`` set, that id follows every text.
    """

    def __init__(self, make: Callable[[list[bytes]], list[np.ndarray]], kind: str, special: list[bytes] = (), end: int | None = None, most: int = REMEMBERED):
        self.make, self.kind, self.special, self.end, self.most = make, kind, list(special), end, most
        self._forget()

    def _forget(self) -> None:
        """Pieces are numbered; two tables, a large one and one of the last, have sorted keys and the pieces' numbers."""
        none = lambda: [np.zeros(0, U64), np.zeros(0, np.int32)]
        self.large, self.last = none(), none()
        self.pool, self.raw = _Growing(self.kind), _Growing("u1")
        self.start, self.count, self.at, self.size = _Growing("<i8"), _Growing("<i4"), _Growing("<i8"), _Growing("<i4")
        self.pool.add(np.array([self.end or 0], self.kind))

    def _made(self, raw: list[bytes]) -> None:
        """Put down what new pieces give, as the next numbers."""
        ids = self.make(raw)
        count = np.array([len(x) for x in ids], np.int64)
        self.start.add(self.pool.n + np.cumsum(count) - count)
        self.count.add(count)
        self.pool.add(np.concatenate(ids))

    def _learn(self, keys: np.ndarray, raw: list[bytes]) -> None:
        """New pieces, with the keys of their bytes; long ones are not found again."""
        first = self.count.n
        self._made(raw)
        size = np.array([len(x) for x in raw], np.int64)
        short = size <= INLINE
        self.at.add(self.raw.n + np.cumsum(size * short) - size * short)
        self.size.add(np.where(short, size, -1))
        self.raw.add(np.frombuffer(b"".join([x for x in raw if len(x) <= INLINE]), np.uint8))
        self._put(keys[short], (first + np.flatnonzero(short)).astype(np.int32))

    def _put(self, keys: np.ndarray, number: np.ndarray) -> None:
        joined = [np.concatenate(x) for x in zip(self.last, (keys, number))]
        if len(joined[0]) > max(20_000, len(self.large[0]) // 4):
            joined = [np.concatenate(x) for x in zip(self.large, joined)]
            order = np.argsort(joined[0], kind="stable")
            self.large, self.last = [x[order] for x in joined], [x[:0] for x in joined]
        else:
            order = np.argsort(joined[0], kind="stable")
            self.last = [x[order] for x in joined]

    def _find(self, keys: np.ndarray, view: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 for those not remembered."""
        number = np.full(len(keys), -1, np.int64)
        for table in (self.large, self.last):
            open_ = np.flatnonzero(number < 0)
            at = lookup(table[0], keys[open_])
            hit = at >= 0
            number[open_[hit]] = table[1][at[hit]]
        found = np.flatnonzero(number >= 0)
        its = number[found]
        pool = np.ndarray(len(self.raw.data) - 7, "<u8", self.raw.data, strides=(1,))
        good = self.size.data[its] == size[found]
        like = np.flatnonzero(good)
        good[like] = same_bytes(view, lo[found[like]], pool, self.at.data[its[like]], size[found[like]])
        number[found[~good]] = -1
        return number

    def _placed(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start and number of ids of every piece, the number of the piece that begins each text or follows the last, and where pieces begin."""
        if self.count.n > self.most or self.pool.n > 16 * self.most:
            self._forget()
        whole = data.tobytes()
        cuts = safe_cuts(data)
        if any(s in whole for s in self.special):  # white space beside them is cut otherwise
            kept = np.array([any(s in whole[i:j] for s in self.special) for i, j in zip(ends, ends[1:])])
            cuts = cuts[~kept[np.searchsorted(ends[:-1], cuts, "right") - 1]]
        begins = np.zeros(len(data) + 1, bool)
        begins[cuts] = begins[ends[:-1]] = True
        lo = np.flatnonzero(begins[:-1])
        hi = np.append(lo[1:], len(data)) if len(lo) else lo
        view = eights(data)
        keys = byte_hashes(data, view, lo, hi)
        number = self._find(keys, view, lo, hi - lo)
        new = np.flatnonzero(number < 0)
        if len(new):
            raw: dict = {}
            which = np.array([raw.setdefault(whole[i:j], len(raw)) for i, j in zip(lo[new].tolist(), hi[new].tolist())])
            _, one = np.unique(which, return_index=True)
            first = self.count.n
            self._learn(keys[new[one]], list(raw))
            number[new] = first + which
        return self.start.data[number], self.count.data[number].astype(np.int64), np.searchsorted(lo, ends), lo

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of all texts, number of ids of each text) of blocks of a string column."""
        for data, ends in raw_blocks(column):
            start, count, at, _ = self._placed(data, ends)
            if self.end is not None:  # one more piece after each text: the end id, with which the pool begins
                start, count = np.insert(start, at[1:], 0), np.insert(count, at[1:], 1)
                at = at + np.arange(len(at))
            total = np.concatenate([[0], np.cumsum(count)])
            yield self.pool.data[np.repeat(start - total[:-1], count) + np.arange(total[-1])], np.diff(total[at])


class PieceCounts(PieceIds):
    """Only the numbers of ids: ``make`` gives a number for each piece."""

    def __init__(self, make: Callable[[list[bytes]], list[int]], most: int = REMEMBERED):
        super().__init__(make, "u1", most=most)

    def _made(self, raw: list[bytes]) -> None:
        self.start.add(np.zeros(len(raw), np.int64))
        self.count.add(np.array(self.make(raw), np.int64))

    def tables(self, column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
        """Of blocks of a string column: the bytes; the ids in front of each piece and of the end, and the byte at which
        each begins; the first piece of each text and of the end, and the byte at which each text begins and the last ends."""
        for data, ends in raw_blocks(column):
            _, count, at, lo = self._placed(data, ends)
            yield data, np.concatenate([[0], np.cumsum(count)]), np.append(lo, len(data)), at, ends
