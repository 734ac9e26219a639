"""Substring dedup by level-wise doubling of repeated word windows.

A word goes if a window of ``size`` consecutive words covers it whose word
sequence also starts in a document with a smaller id.

* A level looks at windows of L words, L being ``start`` at first.  Of every run
  of them that a window of the next length contains, only the one of least hash
  is an anchor: that choice depends on the words alone, so equal longer windows
  choose alike and none is missed, while few rows are shuffled.  Kept are
  anchors that occur in two different texts.
* Only windows repeated at that length are extended: at the next level, of twice
  the length, an anchor is a candidate if it contains one that was kept.  The
  loop ends where no candidate survives, or where twice the length would reach
  ``size``: every window of ``size`` words around a surviving anchor is then
  hashed (two lanes of 64 bits) and grouped, and those whose smallest document
  is another one are repeats.
* ``repeat_levels`` doubles on, without a last length, until no candidate
  survives, and tells how long the repeats of each document are.

Exact copies of a text are settled by a hash of all its words, so a group of
copies enters the levels once; its smallest id stands for it.

Words are runs of characters other than space and U+0009 to U+000D.  Defined
results: null and empty texts have no words; texts of fewer words than a window
lose nothing; a very long text is one row, cut into no pieces; rows that share
an id are one document for "smaller", and each is judged by its own words; a
null id is smaller than none and larger than all; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.shared import written
from sedimenta.llm.wordhash import SPACED, U64, Block, blocks, mix, winnow

SIZE, START = 50, 13
#: Names of rows (8 bytes each, so 16 MB) that are sent to every task at most; beyond it all documents are shuffled.
BROADCAST_IDS = 2_000_000

SPLIT = bytes(i if i not in (9, 10, 11, 12, 13) else 32 for i in range(256))
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def split_words(text: str | None) -> list[bytes]:
    return [w for w in (text or "").encode().translate(SPLIT).split(b" ") if w]


def _anchors(b: Block, length: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``length`` words, and where those stand that some ``reach`` + 1 windows in a row choose."""
    grams = b.grams(length)
    return grams, winnow(grams, reach + 1, b.room()[: len(grams)] >= length + reach)


def _first_pass(batches: Iterator[pa.RecordBatch], length: int, reach: int) -> Iterator[pa.RecordBatch]:
    """One row per document: its words, digests and the hashes of the first level's anchors; columns: doc_id, text, rk."""
    for batch in batches:
        texts = batch.column(1)
        for b in blocks(texts, SPACED):
            grams, at = _anchors(b, length, reach)
            cut = np.searchsorted(at, b.off)
            chosen = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(grams[at].view(np.int64)))
            own = texts.slice(b.first, b.n).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(b.first, b.n),
                    batch.column(2).slice(b.first, b.n),
                    pa.array(np.diff(b.off)),
                    pa.array(b.whole(0).view(np.int64)),
                    pa.array(b.whole(1).view(np.int64)),
                    pa.array([hashlib.sha256(b" ".join(split_words(t))).hexdigest() for t in own]),
                    chosen,
                ],
                ["doc_id", "rk", "n_words", "d1", "d2", "sha", "anchors"],
            )


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Block, np.ndarray, np.ndarray]]:
    """Batch, block, the names of its texts, and which of them are the text that their row asks for and were not met before in this task.

    Columns: text, d1, a list, ...  Rows came together by a hash of id and text.
    """
    met: set = set()
    for batch in batches:
        names = batch.column(1).to_numpy(zero_copy_only=False).view(U64)
        for b in blocks(batch.column(0), SPACED):
            own = names[b.first : b.first + b.n]
            good = b.whole(0) == own
            for i, name in enumerate(own.tolist()):
                if good[i]:
                    good[i] = name not in met
                    met.add(name)
            yield batch, b, own, good


def _around(batch: pa.RecordBatch, b: Block, good: np.ndarray, grams: np.ndarray, at: np.ndarray, reach: int) -> np.ndarray:
    """For each word, whether a window that begins there and goes on for ``reach`` more words holds a surviving anchor (of those at ``at``)."""
    kept, cut, live = batch.column(2), np.searchsorted(at, b.off), []
    for i in np.flatnonzero(good & (np.diff(cut) > 0)).tolist():
        a = at[cut[i] : cut[i + 1]]
        live.append(a[np.isin(grams[a].view(np.int64), kept[b.first + i].values.to_numpy(zero_copy_only=False))])
    near = np.zeros(int(b.off[-1]) + 1, np.int64)
    if live:
        hits = np.concatenate(live)
        np.add.at(near, np.maximum(hits - reach, 0), 1)
        np.add.at(near, hits + 1, -1)
    return np.cumsum(near)[:-1] > 0


def _extend(batches: Iterator[pa.RecordBatch], before: int, length: int, reach: int) -> Iterator[pa.RecordBatch]:
    """d1 and the hashes of the anchors of ``length`` words that hold a surviving one of ``before`` words; columns: text, d1, anchors."""
    for batch, b, own, good in _named(batches):
        old, was = _anchors(b, before, length - before)
        near = _around(batch, b, good, old, was, length - before)
        grams, at = _anchors(b, length, reach)
        at = at[near[at]]
        cut = np.searchsorted(at, b.off)
        some = np.flatnonzero(good & (np.diff(cut) > 0))
        found = [np.unique(grams[at[cut[i] : cut[i + 1]]]) for i in some.tolist()]
        off = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        flat = np.concatenate(found) if found else np.zeros(0, U64)
        yield pa.RecordBatch.from_arrays([pa.array(own[some].view(np.int64)), pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(np.int64)))], ["d1", "anchors"])


def _windows(batches: Iterator[pa.RecordBatch], length: int, size: int) -> Iterator[pa.RecordBatch]:
    """d1, doc_id, p, h1, h2 of every different window around a surviving anchor; columns: text, d1, anchors, doc_id."""
    for batch, b, own, good in _named(batches):
        grams, at = _anchors(b, length, size - length)
        p = np.flatnonzero(_around(batch, b, good, grams, at, size - length) & (b.room() >= size))
        doc = np.searchsorted(b.off, p, "right") - 1
        p, doc = p[good[doc]], doc[good[doc]]
        # a document names a window once, where it is first; _strip finds the other places
        key = b.grams(size, 0, p) ^ mix(doc.astype(U64) + U64(1))
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.sort(order[np.concatenate([[True], key[1:] != key[:-1]])]) if len(order) else order
        p, doc = p[first], doc[first]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(own[doc].view(np.int64)),
                batch.column(3).take(pa.array(doc + b.first)),
                pa.array((p - b.off[doc]).astype(np.int32)),
                pa.array(b.grams(size, 0, p).view(np.int64)),
                pa.array(b.grams(size, 1, p).view(np.int64)),
            ],
            ["d1", "doc_id", "p", "h1", "h2"],
        )


def _strip(batches: Iterator[pa.RecordBatch], size: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    """Remove the covered words; columns: text, d1, starts."""
    for batch, b, names, good in _named(batches):
        texts, starts, rows, out = batch.column(0), batch.column(2), [], []
        grams = b.grams(size)
        for i in np.flatnonzero(good).tolist():
            words = split_words(texts[b.first + i].as_py())
            gone = np.zeros(len(words) + 1, np.int64)
            own = grams[b.off[i] : b.off[i + 1] - size + 1]
            p = np.flatnonzero(np.isin(own, own[starts[b.first + i].values.to_numpy(zero_copy_only=False)]))
            np.add.at(gone, p, 1)
            np.add.at(gone, p + size, -1)
            covered = np.cumsum(gone)[:-1] > 0
            left = b" ".join(w for w, c in zip(words, covered.tolist()) if not c)
            rows.append(i)
            out.append((int(covered.sum()), hashlib.sha256(left).hexdigest(), left.decode() if with_text else None))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names[np.array(rows, np.int64)].view(np.int64)),
                pa.array([x[0] for x in out], pa.int64()),
                pa.array([x[1] for x in out], pa.string()),
                pa.array([x[2] for x in out], pa.string()),
            ],
            ["d1", "cut", "cut_sha", "cut_text"],
        )


def _with(docs: DataFrame, marks: DataFrame, most: int) -> DataFrame:
    """Documents joined with their rows of ``marks`` by rk, the hash of id and text.

    Up to ``most`` of them are sent to every task, so that only texts that are
    needed are shuffled.
    """
    rows = marks.select("rk").distinct()
    if rows.count() <= most:
        docs = docs.join(F.broadcast(rows), "rk", "left_semi")
    return docs.select("rk", "text").join(marks, "rk")


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return d.withColumn("rk", F.xxhash64("doc_id", "text"))


FIRST = "doc_id long, rk long, n_words long, d1 long, d2 long, sha string, anchors array<long>"


def _repeated(anchors: DataFrame) -> DataFrame:
    """(d1, anchors): what of the texts' anchors some other text has too."""
    each = anchors.select("d1", F.explode(F.array_distinct("anchors")).alias("h"))
    twice = each.groupBy("h").agg(F.min("d1").alias("a"), F.max("d1").alias("b")).where("a != b").select("h")
    return each.join(twice, "h").groupBy("d1").agg(F.collect_set("h").alias("anchors"))


def _texts(per_doc: DataFrame, least: int) -> DataFrame:
    """One row per different text of ``least`` words or more: its smallest id, one of its rows, the first level's anchors."""
    found = per_doc.where(F.col("n_words") >= least).groupBy("d1", "d2")
    return written(found.agg(F.min("doc_id").alias("first"), F.min("rk").alias("rk"), F.first("anchors").alias("anchors")), "texts")


def _next_level(d: DataFrame, texts: DataFrame, live: DataFrame, before: int, length: int, reach: int, most: int) -> DataFrame:
    """The anchors of ``length`` words that are repeated, of those that hold a repeated one of ``before`` words."""
    asked = _with(d, live.join(texts.select("d1", "rk"), "d1"), most).select("text", "d1", "anchors")
    return written(_repeated(asked.mapInArrow(lambda it: _extend(it, before, length, reach), "d1 long, anchors array<long>")), "level")


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    with_text: bool = True,
    broadcast_ids: int = BROADCAST_IDS,
    start: int = START,
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (if asked for) kept, the words left joined by one space.

    ``kept`` is null for documents that lose nothing: their words are those of the text.
    """
    if size < 2 or start < 1:
        raise ValueError("a window has two words at least, the first level one")
    length = min(start, size // 2) if start < size else size // 2
    reach = lambda n: min(2 * n, size) - n  # noqa: E731  the next level's length, less this one's
    d = _own(docs, id_col, text_col)
    per_doc = written(d.mapInArrow(lambda it: _first_pass(it, length, reach(length)), FIRST), "words")
    texts = _texts(per_doc, size)
    live = written(_repeated(texts), "level")
    while 2 * length < size and not live.isEmpty():
        live = _next_level(d, texts, live, length, 2 * length, reach(2 * length), broadcast_ids)
        length *= 2

    candidates = live.join(texts.select("d1", "rk", F.col("first").alias("doc_id")), "d1")
    last = length
    windows = written(
        _with(d, candidates, broadcast_ids).select("text", "d1", "anchors", "doc_id").mapInArrow(lambda it: _windows(it, last, size), "d1 long, doc_id long, p int, h1 long, h2 long"),
        "windows",
    )
    # null ids are passed over by min, and larger than all
    smaller = (F.col("most") > F.col("least")) | (F.col("nulls") > 0)
    least = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).where(smaller)
    repeats = windows.join(least.where("least IS NOT NULL").select("h1", "h2", "least"), ["h1", "h2"]).where("doc_id IS NULL OR doc_id > least")
    starts = repeats.groupBy("d1").agg(F.collect_set("p").alias("starts"))
    starts = written(starts.join(texts.select("d1", "rk"), "d1"), "starts")
    cut = (
        _with(d, starts, broadcast_ids)
        .select("text", "d1", "starts")
        .mapInArrow(lambda it: _strip(it, size, with_text), "d1 long, cut long, cut_sha string, cut_text string")
        .dropDuplicates(["d1"])
    )

    copy = (F.col("n_words") >= size) & F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    out = (
        per_doc.drop("anchors", "rk")
        .join(texts.select("d1", "d2", "first"), ["d1", "d2"], "left")
        .join(cut, "d1", "left")
        .select(
            "doc_id",
            "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).cast("long").alias("n_removed"),
            F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
            F.when(copy, F.lit("")).otherwise(F.col("cut_text")).alias("kept"),
        )
    )
    return out if with_text else out.drop("kept")


def repeat_levels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", start: int = START, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """doc_id and length of every row: the longest level (start, 2 start, ...) at which an anchor of the text is repeated in another text, 0 if none.

    A document has a repeat of that many words at least, and none of four times
    as many.  Doubling goes on until no candidate survives.
    """
    if start < 1:
        raise ValueError("the first level has one word at least")
    d = _own(docs, id_col, text_col)
    per_doc = written(d.mapInArrow(lambda it: _first_pass(it, start, start), FIRST), "words")
    texts = _texts(per_doc, 2 * start)
    live, length, found = written(_repeated(texts), "level"), start, None
    while not live.isEmpty():
        now = live.select("d1", F.lit(length).cast("long").alias("length"))
        found = now if found is None else found.union(now)
        live = _next_level(d, texts, live, length, 2 * length, 2 * length, broadcast_ids)
        length *= 2
    if found is None:
        return per_doc.select("doc_id", F.lit(0).cast("long").alias("length"))
    longest = found.groupBy("d1").agg(F.max("length").alias("length"))
    return per_doc.join(longest, "d1", "left").select("doc_id", F.coalesce("length", F.lit(0)).cast("long").alias("length"))


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, p, array_to_string(list_slice(ws, p, p + {SIZE - 1}), ' ') AS win FROM d, unnest(range(1, greatest(len(ws) - {SIZE - 2}, 1))) AS u(p)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY win) AS least FROM x) WHERE doc_id > least),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + {SIZE})) AS q FROM r),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS q FROM d),
k AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.q) AS kept, count(*) AS n FROM w LEFT JOIN g ON w.doc_id = g.doc_id AND w.q = g.q WHERE g.q IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""
