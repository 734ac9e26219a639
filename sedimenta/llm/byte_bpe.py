"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of parts.  For every merge rank that some pair of
neighbours has, a bucket holds the pairs' positions, and a bitmap of two levels
of 256-bit words has the rank's bit set; find-first-set on the upper word, then
on the word below that it points to, gives the least rank in constant time.
A bucket's positions are merged from left to right; entries whose pair has
changed meanwhile are stale and skipped.  Each merge changes two pairs, so a
pre-token of n bytes takes O(n) merges, however long it is.

Defined results: a null text is encoded as an empty one, to no ids; ids are
carried, null or repeated; rows that repeat are encoded one by one; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.pieces import REMEMBERED, PieceIds, Remembered

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


class Codec:
    """Encoder and decoder for a table of token bytes to ranks, which are the ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.words = [0] * ((max(ranks.values(), default=0) >> 8) + 1)  # lower level of the bitmap; all zero between calls
        self.one = Remembered(lambda x: self.merge(x.encode()))
        self.by_piece = PieceIds(self._pieces, "<i4", most=remembered)
        self.digits = {i: str(i) for i in ranks.values()}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}, pattern)

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        get, n = self.ranks.get, len(raw)
        whole = get(raw)
        if whole is not None:
            return [whole]
        words, upper, buckets = self.words, 0, {}
        end = list(range(1, n + 1))  # of the part that starts there
        before = list(range(-1, n))  # start of the part in front; -1 for none
        pair = [get(raw[i : i + 2], -1) for i in range(n)]  # rank of the part there and the next, -1 for none
        pair[-1] = -1
        for i, r in enumerate(pair):
            if r >= 0:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    words[r >> 8] |= 1 << (r & 255)
                    upper |= 1 << (r >> 8)
        while upper:
            w = (upper & -upper).bit_length() - 1
            bits = words[w]
            lowest = bits & -bits
            rank = (w << 8) + lowest.bit_length() - 1
            words[w] = bits = bits ^ lowest
            if not bits:
                upper &= upper - 1
            places = buckets.pop(rank)
            if len(places) > 1:
                places.sort()
            for i in places:
                if pair[i] != rank:
                    continue  # stale
                j = end[i]
                pair[j] = -1
                e = end[i] = end[j]
                b = before[i]
                if e < n:
                    before[e] = i
                    r = pair[i] = get(raw[i : end[e]], -1)
                    if r >= 0:
                        if r in buckets:
                            buckets[r].append(i)
                        else:
                            buckets[r] = [i]
                            words[r >> 8] |= 1 << (r & 255)
                            upper |= 1 << (r >> 8)
                else:
                    pair[i] = -1
                if b >= 0:
                    r = pair[b] = get(raw[b:e], -1)
                    if r >= 0:
                        if r in buckets:
                            buckets[r].append(b)
                        else:
                            buckets[r] = [b]
                            words[r >> 8] |= 1 << (r & 255)
                            upper |= 1 << (r >> 8)
        out, i = [], 0
        while i < n:
            out.append(get(raw[i : end[i]]))
            i = end[i]
        return out

    def _pieces(self, raw: list[bytes]) -> list[np.ndarray]:
        return [np.array(self.encode(x.decode()), np.int32) for x in raw]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text."""
        return [i for t in self.find(text or "") for i in self.one[t]]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def encode_column(self, column: pa.Array) -> Iterator[list[int]]:
        """Ids of every text of a column (null: none)."""
        for ids, count in self.by_piece.encode(column):
            listed, at = ids.tolist(), 0
            for n in count.tolist():
                yield listed[at : at + n]
                at += n

    def summaries(self, column: pa.Array) -> Iterator[tuple[int, str, str]]:
        """Number of ids, digest of the ids, digest of what the ids decode to, of every text of a column."""
        for ids in self.encode_column(column):
            shown = ",".join(map(self.digits.__getitem__, ids))
            yield len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


@lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker and vocabulary."""
    return Codec.from_file(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids (array of int) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for a in range(0, len(batch), 64):
                part = batch.slice(a, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(c.encode_column(part.column(1))), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _own(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the bytes that each row's ids stand for (null ids: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for a in range(0, len(batch), 64):
                part = batch.slice(a, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.decode(x or []) for x in part.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return encoded.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids")).mapInArrow(run, "doc_id long, bytes binary")


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def encode_report(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            rows = list(c.summaries(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _own(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
