"""Benchmark decontamination by winnowing.

Of every run of ``window - k + 1`` consecutive k-grams the one of least hash is
kept as a fingerprint, so any span of ``window`` words that a document shares
with a benchmark item has a fingerprint in both.  Fingerprints of documents are
joined with those of the benchmark; around every hit the windows that contain
it are compared with the benchmark's windows by a 128-bit hash.  Items shorter
than a window are one window of their own length, compared directly.

A window is one row, however many items have it, with the name of the set of
those items; a document's hits so name windows and sets, and the items of a set
are listed once a document.

The benchmark's windows are counted first, once for each item that has them.  Up
to ``broadcast_windows`` they are sent to every task and documents are read once,
without any shuffle; beyond it fingerprints and windows are joined by shuffles.
Both ways give the same rows.

Words: A-Z are lower-cased, a word is a run of digits, ASCII letters and
characters above U+007F.  Defined results: null or empty texts have no words
and no hits; a very long text is one row, compared as a whole; null ids are
carried (a null item is named ''); rows that repeat are judged one by one; two items of equal text both count; empty tables give
no rows, or no hits; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.shared import written
from sedimenta.llm.wordhash import ALNUM, Block, blocks, lookup, winnow

WINDOW, GRAM = 10, 5
#: Benchmark windows (about 50 bytes each) that are sent to every task at most.
BROADCAST_WINDOWS = 400_000

OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """h1, h2, size, item of every window of benchmark items."""
    for batch in batches:
        items = batch.column(0)
        for b in blocks(batch.column(1), ALNUM, True):
            n = np.diff(b.off)
            room = b.room()
            doc = np.repeat(np.arange(b.n), n)
            for size in sorted({window, *np.unique(n[(n > 0) & (n < window)]).tolist()}):
                at = np.flatnonzero((room >= size) & ((n[doc] == size) if size < window else True))
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [_long(b.grams(size, 0, at)), _long(b.grams(size, 1, at)), pa.array(np.full(len(at), size)), items.take(pa.array(doc[at] + b.first))],
                        ["h1", "h2", "size", "item"],
                    )


def _prints(b: Block, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a block's fingerprints."""
    grams = b.grams(k)
    room = b.room()
    at = winnow(grams, window - k + 1, room[: len(grams)] >= window)
    return at, grams[at]


def _fingerprints(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[pa.RecordBatch]:
    """row, p, f of every fingerprint; row is the batch's first column (a whole-row key or the item)."""
    for batch in batches:
        for b in blocks(batch.column(1), ALNUM, True):
            at, f = _prints(b, window, k)
            doc = np.searchsorted(b.off, at, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc + b.first)), pa.array(at - b.off[doc]), _long(f)], ["row", "p", "f"]
            )


def _around(b: Block, hits: np.ndarray, window: int, k: int) -> np.ndarray:
    """Starts of the windows that contain a k-gram at one of ``hits`` and lie within one text."""
    starts = np.unique((hits[:, None] - np.arange(window - k + 1)[None, :]).ravel())
    starts = starts[starts >= 0]
    doc = np.searchsorted(b.off, starts, "right") - 1
    return starts[starts + window <= b.off[doc + 1]]


def _digest(names: set) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


class Index:
    """The benchmark's windows and fingerprints as sorted arrays."""

    def __init__(self, rows: pa.Table, prints: np.ndarray, window: int, k: int):
        h1, h2, size = (rows.column(c).to_numpy() for c in ("h1", "h2", "size"))
        self.window, self.k, self.prints = window, k, np.unique(prints.view(np.uint64))
        items = ["" if x is None else x for x in rows.column("item").to_pylist()]
        self.sets: list[frozenset] = []  # different sets of items that have a window
        known: dict[frozenset, int] = {}
        self.by_size = {}
        for s in np.unique(size):
            own = np.flatnonzero(size == s)
            order = own[np.lexsort((h2[own].view(np.uint64), h1[own].view(np.uint64)))]
            a, b = h1[order].view(np.uint64), h2[order].view(np.uint64)
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            of = np.empty(len(new), np.int64)
            for i, (lo, hi) in enumerate(zip(new.tolist(), [*new[1:].tolist(), len(order)])):
                names = frozenset(items[r] for r in order[lo:hi].tolist())
                if names not in known:
                    known[names] = len(self.sets)
                    self.sets.append(names)
                of[i] = known[names]
            self.by_size[int(s)] = (a[new], b[new], of)

    def find(self, b: Block, size: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows of ``size`` words among ``at`` that the benchmark has, and the sets of items that have them."""
        h1, h2, of = self.by_size[size]
        place = lookup(h1, b.grams(size, 0, at))
        at, place = at[place >= 0], place[place >= 0]
        if not len(at):
            return at, place
        second, first = b.grams(size, 1, at), h1[place]
        place = np.searchsorted(h1, first, "left")
        good = h2[place] == second
        while True:  # windows that differ in the second hash only stand next to one another
            place = np.where(good, place, place + 1)
            more = ~good & (place < len(h1))
            more[more] = h1[place[more]] == first[more]
            if not more.any():
                return at[good], of[place[good]]
            good[more] = h2[place[more]] == second[more]

    def judge(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(10_000)
        def named(sets: tuple[int, ...]) -> tuple[int, str]:
            names = set().union(*(self.sets[i] for i in sets))
            return len(names), _digest(names)

        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for b in blocks(batch.column(1), ALNUM, True):
                n, room = np.diff(b.off), b.room()
                edge = np.zeros(len(room) + 1, np.int64)
                pairs = []
                for size in self.by_size:
                    if size == self.window:
                        at, f = _prints(b, self.window, self.k)
                        near = _around(b, at[lookup(self.prints, f) >= 0], self.window, self.k)
                    else:
                        near = np.flatnonzero(room >= size)
                    p, sets = self.find(b, size, near)
                    np.add.at(edge, p, 1)
                    np.add.at(edge, p + size, -1)
                    pairs.append(np.stack([np.searchsorted(b.off, p, "right") - 1, sets], 1))
                total = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])
                hit = total[b.off[1:]] - total[b.off[:-1]]
                met: dict[int, list[int]] = {}
                for doc, one in np.unique(np.concatenate(pairs), axis=0).tolist() if pairs else ():
                    met.setdefault(doc, []).append(one)
                for i in range(b.n):
                    out.append((ids[b.first + i], int(n[i]), int(hit[i]), *named(tuple(met.get(i, ()))), bool(hit[i])))
            yield _table(out)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    names = [c.split(" ")[0] for c in OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """One row per row of ``docs``: words, words hit, items met, and their digest."""
    c = lambda x: F.col(f"`{x}`")
    d = docs.select(c(id_col).cast("long").alias("doc_id"), c(text_col).cast("string").alias("text"))
    items = benchmark.select(c(item_col).cast("string").alias("item"), c(item_text_col).cast("string").alias("text"))
    wins = items.mapInArrow(lambda it: _windows(it, window), "h1 long, h2 long, size long, item string").distinct()
    prints = items.mapInArrow(lambda it: _fingerprints(it, window, gram), "row string, p long, f long").select("f").distinct()
    small = wins.limit(broadcast_windows + 1).count() <= broadcast_windows
    if small:  # then there are no more fingerprints than windows either
        index = Index(wins.toArrow(), prints.toArrow().column("f").to_numpy().astype(np.int64), window, gram)
        shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by broadcast_windows
        return d.mapInArrow(lambda it: shared.value.judge(it), OUT)
    return _by_shuffles(d, wins, prints, window, gram)


def _by_shuffles(d: DataFrame, wins: DataFrame, prints: DataFrame, window: int, k: int) -> DataFrame:
    """The same result when the benchmark is too large to send to every task.

    Rows are known by a digest of id and text; rows that agree in both get the
    same answer.
    """
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("n")), F.coalesce(F.col("text"), F.lit(""))), 256)
    docs = d.withColumn("row", key)
    # windows are joined by name of their set of items, so that one that all items have is one row
    grouped = wins.groupBy("h1", "h2", "size").agg(F.sort_array(F.collect_set(F.coalesce("item", F.lit("")))).alias("items"))
    named = written(grouped.withColumn("set", F.sha2(F.to_json("items"), 256)), "bench-windows")
    sets = named.groupBy("set").agg(F.first("items").alias("items"))
    wins = named.select("h1", "h2", "size", "set")
    sizes = sorted(r["size"] for r in wins.select("size").distinct().collect())
    own = docs.select("row", "text").distinct()
    hits = (
        own.mapInArrow(lambda it: _fingerprints(it, window, k), "row string, p long, f long")
        .join(prints, "f", "left_semi")
        .groupBy("row")
        .agg(F.collect_list("p").alias("at"))  # no more than the document's words
    )

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_pylist()
            for b in blocks(batch.column(1), ALNUM, True):
                room = b.room()
                marks = [b.off[i] + np.array(at[b.first + i], np.int64) for i in range(b.n) if at[b.first + i]]
                near = _around(b, np.concatenate(marks), window, k) if marks else np.zeros(0, np.int64)
                for size in sizes:
                    p = near if size == window else np.flatnonzero(room >= size)
                    doc = np.searchsorted(b.off, p, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(doc + b.first)), pa.array(p - b.off[doc]), pa.array(np.full(len(p), size)), _long(b.grams(size, 0, p)), _long(b.grams(size, 1, p))],
                        ["row", "p", "size", "h1", "h2"],
                    )

    looked = own.join(hits, "row", "left" if any(s < window for s in sizes) else "inner").select("row", "text", "at")
    met = looked.mapInArrow(candidates, "row string, p long, size long, h1 long, h2 long").join(wins, ["h1", "h2", "size"])
    met = written(met.select("row", "p", "size", "set"), "bench-hits")
    spans = met.groupBy("row").agg(F.collect_set(F.struct("p", "size")).alias("spans"))
    items = met.select("row", "set").distinct().join(sets, "set").groupBy("row").agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    per = spans.join(items, "row")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spans, items = (batch.column(i).to_pylist() for i in (0, 2, 3))
            out = []
            for b in blocks(batch.column(1), ALNUM, True):
                n = np.diff(b.off)
                for i in range(b.n):
                    r = b.first + i
                    covered = np.zeros(int(n[i]), bool)
                    for s in spans[r] or []:
                        covered[s["p"] : s["p"] + s["size"]] = True
                    own = set(items[r] or [])
                    out.append((ids[r], int(n[i]), int(covered.sum()), len(own), _digest(own), bool(covered.any())))
            yield _table(out)

    return docs.join(per, "row", "left").select("doc_id", "text", "spans", "items").mapInArrow(judge, OUT)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that share no window with an item, with their columns unchanged.

    Contaminated documents are found by id and text, so rows that share an id
    are judged by their own texts.
    """
    same = lambda x: F.xxhash64(F.coalesce(x, F.lit("")))
    key = F.xxhash64(F.struct(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), same(F.col(f"`{text_col}`").cast("string"))))
    own = docs.select(key.alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = contamination(own, benchmark, **options).where("contaminated").select(F.col("doc_id").alias("key")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"))  # apart, so names cannot clash
    return rows.join(found, "key", "left_anti").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(len(ws), {WINDOW}) AS size, list_slice(ws, p, p + least(len(ws), {WINDOW}) - 1) AS win
      FROM i, unnest(range(1, greatest(len(ws) - {WINDOW} + 2, 2))) AS u(p) WHERE len(ws) > 0),
s AS (SELECT DISTINCT size FROM w),
x AS (SELECT doc_id, p, size, list_slice(ws, p, p + size - 1) AS win FROM d, s, unnest(range(1, greatest(len(ws) - size + 2, 1))) AS u(p)),
m AS (SELECT doc_id, p, x.size, item_id FROM x JOIN w ON x.size = w.size AND x.win = w.win),
h AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""
