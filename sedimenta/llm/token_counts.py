"""Token counts at every prefix of a text by dynamic programming.

The tokenizer joins characters of a pre-token by ranked merges and marks its
end.  For a pre-token of n symbols the table holds, for every i, the last token
of the encoding of the first i symbols without the end mark: among the tokens
that end there it is the one that may follow the last token of what is in front
of it, where two tokens may follow one another if merging their symbols gives
just those two.  Its count is one more than that of what is in front.  The table
is filled from the front, each prefix being extended by the tokens that go on.  The same
step with the end mark gives the exact count of the prefix as a text of its
own.  Over a text, counts before each pre-token are summed up, so any prefix,
truncation or budget is answered from the table without encoding again.

Normalisation (composed forms, lower case) is the library's for pieces with
characters beyond U+024F, piece by piece; their pre-tokens go through the same
table.  A prefix that ends between characters which normalisation may join is
counted by extending the table in front of them by what that end becomes.  Only
pieces with special strings are split at them by the library.

``count_tokens`` builds the table of each text (ids in front of each piece, and
within a piece where needed) and derives total and truncation from it;
``prefix_tables`` stores it, and ``cut_at`` answers any budget from it without a
text or tokenizer.

Defined results: a null text is empty and has no tokens; a very long text, with
or without spaces, takes time in proportion to its length; ids are carried, null
or repeated; equal rows, or ties, are counted one by one and get equal rows; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.pieces import PieceCounts, Remembered

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Fixed pattern that the vocabulary's file states for its pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


@lru_cache(1)
def _joining() -> frozenset:
    """Characters that composition may join to what is in front of them: marks, and the second ones of composed pairs."""
    out = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for c in map(chr, range(0x110000)):
        if unicodedata.combining(c):
            out.add(c)
        pair = unicodedata.decomposition(c).split(" ")
        if len(pair) == 2 and not pair[0].startswith("<"):
            out.add(chr(int(pair[1], 16)))
    return frozenset(out)


class Counter:
    """Exact token counts under a vocabulary file of ranked merges with an end mark."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.library = Tokenizer.from_file(path)
        self.end = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        self.rank = {(m if isinstance(m, str) else " ".join(m)): i for i, m in enumerate(model["merges"])}
        self.longest = max(map(len, self.vocab)) if self.vocab else 0
        bodies = {t[: -len(self.end)] if self.end and t.endswith(self.end) else t for t in self.vocab}
        self.starts = {t[:i] for t in bodies for i in range(1, len(t) + 1)}  # whatever some token begins with
        closed = [t[: -len(self.end)] for t in self.vocab if self.end and t.endswith(self.end)] if self.end else list(self.vocab)
        self.tails = {t[i:] for t in closed for i in range(len(t))}  # whatever some closed token ends with
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.symbols = _byte_symbols()
        self.find = regex.compile(PATTERN)
        self.word = Remembered(self._word, 600_000)
        self.piece = Remembered(self._count, 50_000)
        self.follows = Remembered(self._follows, 600_000)
        self.whole = Remembered(lambda t: 1 if self._merged(self._split(t)) == [t] else 2, 2 * len(self.vocab) + 2)
        self.by_piece = PieceCounts(lambda raw: [self._count(x.decode()) for x in raw])

    # two tokens side by side

    def _merged(self, parts: list[str]) -> list[str]:
        while len(parts) > 1:
            best = min((self.rank.get(f"{a} {b}", 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] == 1 << 60:
                break
            a, b = parts[best[1]], parts[best[1] + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _split(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _follows(self, pair: str) -> int:
        a, b = pair.split(" ")
        return 1 if self._merged(self._split(a) + self._split(b)) == [a, b] else 2

    # one pre-token

    def _fill(self, symbols: str, last: list[str], count: list[int], begin: int) -> None:
        """Last token and number of tokens of each prefix, without the end mark, from those of up to ``begin`` symbols and fewer.

        What is known of a prefix is extended by every token that begins there
        and may follow, until no token goes on so.
        """
        vocab, starts, follows, whole, most = self.vocab, self.starts, self.follows, self.whole, len(last) - 1
        for j in range(begin, most):
            front, n = last[j], count[j] + 1
            if j and not front:
                raise ValueError(f"no token ends at {j} of {symbols!r}")
            for i in range(j + 1, most + 1):
                token = symbols[j:i]
                if token not in starts:
                    break
                if token in vocab and (follows[f"{front} {token}"] if j else whole[token]) == 1:
                    last[i], count[i] = token, n

    def _open(self, symbols: str, most: int) -> tuple[list[str], list[int]]:
        last, count = [""] * (most + 1), [0] * (most + 1)
        self._fill(symbols, last, count, 0)
        return last, count

    def _closed(self, symbols: str, i: int, last: list[str], count: list[int]) -> int:
        """Number of tokens of the first i symbols with the end mark set."""
        for j in range(i - 1, -1, -1):
            body = symbols[j:i]
            if body not in self.tails:
                break
            token = body + self.end
            if token in self.vocab and (self.follows[f"{last[j]} {token}"] if j else self.whole[token]) == 1:
                return count[j] + 1
        raise ValueError(f"no token ends at {i} of {symbols!r}")

    def table(self, symbols: str) -> tuple[list[int], list[int]]:
        """Counts of the prefixes of a pre-token's symbols: open (more follows) and closed (the end mark set)."""
        last, count = self._open(symbols, len(symbols))
        return count, [0] + [self._closed(symbols, i, last, count) for i in range(1, len(symbols) + 1)]

    def _word(self, word: str) -> int:
        """Tokens of one pre-token, in the vocabulary's symbols."""
        token = word + self.end
        if token in self.vocab and self.whole[token] == 1:
            return 1
        last, count = self._open(word, len(word) - 1)
        return self._closed(word, len(word), last, count)

    def _symbols(self, token: str) -> str:
        return "".join([self.symbols[b] for b in token.encode()])

    # pieces between spaces

    def plain(self, piece: str) -> bool:
        """Whether lower-casing alone is what normalisation does."""
        return piece.isascii() or all(c < "ɐ" and c != "İ" for c in piece)

    def _normal(self, piece: str) -> str:
        return piece.lower() if self.plain(piece) else self.library.normalizer.normalize_str(piece)

    def _cut(self, piece: str) -> list[str]:
        """A piece's texts and special strings, in turn: every second one is special."""
        out, rest = [], piece
        while True:
            at = min(((rest.find(x), x) for x in self.special if x in rest), default=None)
            if at is None:
                return [*out, rest]
            out += [rest[: at[0]], at[1]]
            rest = rest[at[0] + len(at[1]) :]

    def _count(self, piece: str) -> int:
        if "<|" in piece and any(x in piece for x in self.special):
            return sum(self._count(x) if i % 2 == 0 else 1 for i, x in enumerate(self._cut(piece)))
        if self.plain(piece):
            return sum([self.word[self._symbols(t)] for t in self.find.findall(piece.lower())])
        return sum([self.word[t] for t, _ in self.library.pre_tokenizer.pre_tokenize_str(self._normal(piece))])

    def count(self, text: str | None) -> int:
        return int(sum(n[-1] for _, n, *_ in self.by_piece.tables(pa.array([text or ""]))))

    def prefix_counts(self, text: str | None) -> list[int]:
        """Token count of each prefix of the text: of 0, 1, ... all characters."""
        out = [0]
        for data, total, lo, _, _ in self.by_piece.tables(pa.array([text or ""])):
            for k, (i, j) in enumerate(zip(lo.tolist(), lo[1:].tolist())):
                piece = data[i:j].tobytes().decode()
                if k:
                    out.append(int(total[k]))  # the space that begins the piece adds none
                out += [int(total[k]) + n for n in self._within(piece[1:] if k else piece)]
        return out

    def _within(self, piece: str) -> list[int]:
        """Counts of the prefixes of 1, 2, ... characters of a piece."""
        if "<|" in piece and any(x in piece for x in self.special):
            out, done, front = [], 0, ""
            for k, part in enumerate(self._cut(piece)):
                if k % 2 == 0:
                    front = part
                    out += [done + n for n in self._within(part)]
                else:  # an unfinished special string is text, after the text in front of it
                    out += [done + n for n in self._within(front + part[:-1])[len(front) :]]
                    done += self._count(front) + 1
                    out.append(done)
            return out
        return self._spelled(piece) if self.plain(piece) else self._composed(piece)

    def _spelled(self, low: str) -> list[int]:
        """Counts of the prefixes of 1, 2, ... characters of what normalisation gives."""
        out, done, at, low = [], 0, 0, low.lower() if self.plain(low) else low
        for m in self.find.finditer(low):
            out += [done] * (m.start() - at)
            token = m[0]
            cut = [self.find.findall(token[:i]) for i in range(1, len(token) + 1)] if token[0] == "'" and len(token) > 1 else None
            if cut:  # a contraction's prefix may be other pre-tokens
                out += [done + sum(self.word[self._symbols(t)] for t in c) for c in cut]
                done = out[-1]
            else:
                closed = self.table(self._symbols(token))[1]
                ends = list(accumulate(len(c.encode()) for c in token))
                out += [done + closed[e] for e in ends]
                done += closed[-1]
            at = m.end()
        return out + [done] * (len(low) - at)

    def _composed(self, piece: str) -> list[int]:
        """Counts of the prefixes of a piece that normalisation changes: by clusters of characters that it may join."""
        joining, clusters = _joining(), []
        for c in piece:
            if c in joining and clusters:
                clusters[-1] += c
            else:
                clusters.append(c)
        whole = [self._normal(c) for c in clusters]
        text = "".join(whole)
        counts, tables = [0, *self._spelled(text)], {}
        starts = [m.start() for m in self.find.finditer(text)]
        out, at = [], 0
        for cluster, normal in zip(clusters, whole):
            for i in range(1, len(cluster)):
                part = self._normal(cluster[:i])
                if normal.startswith(part):
                    out.append(counts[at + len(part)])
                else:
                    out.append(self._ending(text, at, part, starts, counts, tables))
            at += len(normal)
            out.append(counts[at])
        return out

    def _ending(self, text: str, at: int, part: str, starts: list[int], counts: list[int], tables: dict) -> int:
        """Tokens of text[:at] + part: the pre-token that ``part`` goes on is extended, whatever its length."""
        k = bisect_left(starts, at) - 1
        begin = starts[k] if k >= 0 else 0
        contracted = k > 0 and at - begin <= 2 and text[begin - 1] == "'"  # it may become one with what is in front
        if contracted:
            begin = starts[k - 1]
        if not (k >= 0 and text[begin:at].isalpha() and part.isalpha()):
            return counts[begin] + sum(self.word[self._symbols(t)] for t in self.find.findall(text[begin:at] + part))
        if begin not in tables:
            tables.clear()
            end = starts[k + 1] if k + 1 < len(starts) else len(text)
            symbols = self._symbols(text[begin:end])
            tables[begin] = symbols, *self._open(symbols, len(symbols))
        symbols, last, count = tables[begin]
        n, more = len(text[begin:at].encode()), self._symbols(part)
        symbols, last, count = symbols[:n] + more, last[: n + 1] + [""] * len(more), count[: n + 1] + [0] * len(more)
        self._fill(symbols, last, count, max(0, n - self.longest))
        return counts[begin] + self._closed(symbols, len(symbols), last, count)

    def fitting(self, table: tuple, text: int, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens of a text of a block, from the block's table."""
        data, total, lo, at, ends = table
        a, b = int(at[text]), int(at[text + 1])
        chars = lambda i, j: int(((data[i:j] & 0xC0) != 0x80).sum())
        k = a + int(np.searchsorted(total[a + 1 : b + 1] - total[a], budget, "right"))  # the piece that does not fit
        if k == b:
            return chars(ends[text], ends[text + 1])
        piece = data[lo[k] : lo[k + 1]].tobytes().decode()
        inside = self._within(piece[1:]) if k > a else self._within(piece)
        fits = [i for i, n in enumerate(inside, 1) if total[k] - total[a] + n <= budget]
        return chars(ends[text], lo[k]) + (fits[-1] if fits else 0) + (k > a)


@lru_cache(4)
def counter(path: str) -> Counter:
    """One counter per worker and vocabulary."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fits_chars, the characters that fit into the limit, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            fits = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
            counts, first = [np.zeros(0, np.int64)], 0
            for table in c.by_piece.tables(text):
                counts.append(np.diff(table[1][table[3]]))
                for i in np.flatnonzero(counts[-1] > limit).tolist():
                    fits[first + i] = c.fitting(table, i, limit)
                first += len(counts[-1])
            n = np.concatenate(counts)
            over = n > limit
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(text).cast(pa.int64()), pa.array(n), pa.array(over), pa.array(fits)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars"],
            )

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits_chars long")


def prefix_tables(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, chars and tokens of every row: the characters and tokens of each prefix that ends where a piece does (and of the empty one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            first = 0
            for data, total, lo, at, ends in c.by_piece.tables(pc.fill_null(batch.column(1), "")):
                place = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                n = len(at) - 1
                chars = [np.append(0, place[lo[i + 1 : j + 1]] - place[e]) for i, j, e in zip(at, at[1:], ends)]
                tokens = [total[i : j + 1] - total[i] for i, j in zip(at, at[1:])]
                kind = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(chars, kind), pa.array(tokens, kind)], ["doc_id", "chars", "tokens"])
                first += n

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, chars array<long>, tokens array<long>")


def cut_at(tables: DataFrame, budget: int) -> DataFrame:
    """doc_id, n_tokens and fits_chars of every row of ``prefix_tables``: the longest stored prefix of at most ``budget`` tokens."""
    fits = F.filter(F.arrays_zip("chars", "tokens"), lambda x: x["tokens"] <= budget)
    return tables.select("doc_id", F.element_at("tokens", -1).alias("n_tokens"), F.element_at(fits, -1)["chars"].alias("fits_chars"))


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(VOCABULARY))
