"""Language-model scoring with a hashed maximum-entropy model.

Every word of the vocabulary belongs to a cell: a class, by its share of the
training tokens, and a bucket within the class.  Words with a share of less than
``MIN_SHARE`` are the last class, their bucket taken from their hash; that rule
is the same at every size.  A word's probability is

    P(class | context) P(bucket | class, context) (c + 1) / (cell's tokens + words + 1)

with c the word's count in training, so one share of every cell is that of
unknown words: context chooses among the 256 cells, and within a cell a word has
its unigram share.  Both softmaxes are maximum-entropy models over hashed features
of the context: the word before, the two words before, and the word before that
(a skip), on top of fixed priors.  The rows that features are hashed to grow with
the training tokens, up to ``MAX_ROWS``, the bound of what is sent to every task.

Weights are learned by distributed gradient updates: every task runs over its
training documents from the common weights in sparse batches, and a row's change
is averaged over the tasks by how often each met the row, in a tree.  So scores
depend, in their far digits, on how the input is dealt to tasks; counts, and the
base score, do not.

Counts are exact and cover all training documents.  They live in tables that
are dealt by ranges of the words' hashes and grow with the corpus; the words of
at least ``MIN_SHARE``, which are 1 / MIN_SHARE at most, and the weights, are
what tasks and driver hold.  Tokens of other words are looked up by sending them
to the ranges.

A document trains the model unless crc32 of its id's decimal text is 2 modulo
7; all documents are scored.  Tokens: A-Z lower-cased, words are runs of
characters other than space and U+0009 to U+000D, and one end follows.

Defined results: a null or empty text has the end alone; a very long text is one
row, scored in batches; a null id counts as the empty text, and so trains; rows
that share an id or repeat are counted and scored one by one, and equal texts
get equal scores; words of equal counts are ordered by their hashes; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.shared import written
from sedimenta.llm.wordhash import SPACED, U64, blocks, lookup, mix

FOLDS, HELD_OUT = 7, 2
#: Least share of the training tokens of a word of the table that is sent to every task (13 bytes a word, so 52 MB at most).
MIN_SHARE = 2.5e-7
CLASSES, BUCKETS = 16, 16
#: Training tokens for a row of weights (128 bytes), and the least and greatest number of rows, which is a power of two.
ROW_TOKENS, MIN_ROWS, MAX_ROWS = 128, 1 << 14, 1 << 17
#: Tokens of a batch are 2 ** PLACE_BITS at most.
RATE, PLACE_BITS = 0.1, 13
BATCH = 1 << PLACE_BITS
#: Bound of a logit, and what sums rows of shares.
LOGIT, ONES = 60, np.ones(CLASSES, np.float32)
#: Bytes of packed counts that one task merges about, and entries that a task holds before it sends them on.
RANGE_BYTES, HELD = 8 << 20, 3_000_000
#: Tasks' changes that are added up in one step.
FAN_IN = 128
END = U64(0x5EED0E2D5EED0E2D)


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, texts, token hashes with ends, offsets) of blocks of texts."""
    for b in blocks(column, SPACED, True):
        off = b.off + np.arange(b.n + 1)
        out = np.empty(off[-1], U64)
        ends = off[1:] - 1
        body = np.ones(len(out), bool)
        body[ends] = False
        out[body] = b.words(0)
        out[ends] = END
        yield b.first, b.n, out, off


def _to_range(h: np.ndarray, ranges: int) -> np.ndarray:
    return (((h >> U64(32)) * U64(ranges)) >> U64(32)).astype(np.int32)


def _add_up(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[at], np.add.reduceat(c, at) if len(at) else c


def _by_range(ranges: int, kind: int, h: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Rows (range, kind, packed columns) of entries sorted by h."""
    to = _to_range(h, ranges)
    at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
    table = np.stack([h, *(c.astype(np.int64).view(U64) for c in columns)], 1)
    cut = [table[i:j].tobytes() for i, j in zip(at.tolist(), [*at[1:].tolist(), len(to)])]
    return pa.RecordBatch.from_arrays([pa.array(to[at]), pa.array(np.full(len(at), kind, np.int32)), pa.array(cut, pa.binary())], ["range", "kind", "packed"])


PACKED = "range int, kind int, packed binary"


def _count(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """Packed (word, count) of training texts, added up within the task."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def send() -> pa.RecordBatch:
        return _by_range(ranges, 0, *_add_up(np.concatenate([x for x, _ in held]), np.concatenate([c for _, c in held])))

    n = 0
    for batch in batches:
        for _, _, tokens, _ in _tokens(batch.column(0)):
            h, c = np.unique(tokens, return_counts=True)
            held.append((h, c))
            n += len(h)
            if n >= HELD:
                yield send()
                held, n = [], 0
    if held:
        yield send()


def _unpack(packed, width: int) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), U64).reshape(-1, width) for x in packed]
    return np.concatenate(parts) if parts else np.zeros((0, width), U64)


def _merge(table: pa.Table) -> pa.Table:
    """One range's counts: packed words and counts."""
    t = _unpack(table.column("packed"), 2)
    h, c = _add_up(t[:, 0].copy(), t[:, 1].copy().view(np.int64))
    return pa.table(
        {
            "range": table.column("range")[:1],
            "words": pa.array([len(h)], pa.int64()),
            "tokens": pa.array([int(c.sum())], pa.int64()),
            "packed": pa.array([np.stack([h, c.view(U64)], 1).tobytes()], pa.binary()),
        }
    )


def _frequent(table: pa.Table, least: int) -> pa.Table:
    """The words of some ranges that occur ``least`` times."""
    parts = [t[t[:, 1].view(np.int64) >= least] for t in (np.frombuffer(x.as_buffer(), U64).reshape(-1, 2) for x in table.column("packed"))]
    return pa.table({"often": pa.array([np.concatenate(parts).tobytes()], pa.binary())})


def _rare(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """By bucket, what the last class has of the others."""
    mass, words = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for x in batch.column(0):
            t = np.frombuffer(x.as_buffer(), U64).reshape(-1, 2)
            t = t[t[:, 1].view(np.int64) < least]
            bucket = (t[:, 0] >> U64(60)).astype(np.int64)
            mass += np.bincount(bucket, t[:, 1].view(np.int64), minlength=BUCKETS).astype(np.int64)
            words += np.bincount(bucket, minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(mass), pa.array(words)], ["bucket", "mass", "words"])


class Model:
    """The table of frequent words, the cells, priors and weights."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, rare_mass: np.ndarray, rare_words: np.ndarray, tokens: int, types: int):
        self.tokens, self.types, self.complete = tokens, types, len(words) == types
        order = np.lexsort((words, -counts))
        share = (np.cumsum(counts[order]) - counts[order]) / max(1, counts.sum())
        klass = np.minimum((share * (CLASSES - 1)).astype(np.int64), CLASSES - 2)
        rank = np.arange(len(order)) - np.searchsorted(klass, klass)  # within the class
        cell = np.empty(len(order), np.uint8)
        cell[order] = klass * BUCKETS + rank % BUCKETS
        by = np.argsort(words)
        self.words, self.counts, self.cell = words[by], counts[by].astype(np.uint32 if counts.max(initial=0) < 2**32 else np.int64), cell[by]
        mass = np.bincount(self.cell, counts[by], minlength=CLASSES * BUCKETS)
        kinds = np.bincount(self.cell, minlength=CLASSES * BUCKETS)
        mass[-BUCKETS:] += rare_mass
        kinds[-BUCKETS:] += rare_words
        self.spread = np.log10(mass + kinds + 1)
        cells = (mass + 1).reshape(CLASSES, BUCKETS)
        self.class_prior = np.log(cells.sum(1) / cells.sum()).astype(np.float32)
        self.bucket_prior = np.log(cells / cells.sum(1, keepdims=True)).astype(np.float32)
        need = max(1, -(-tokens // ROW_TOKENS))
        self.bits = (min(max(need, MIN_ROWS), MAX_ROWS) - 1).bit_length()
        self.weights = np.zeros((2, 1 << self.bits, CLASSES), np.float32)

    def cells(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index into the table (-1: not there) and cell of each token."""
        at = lookup(self.words, tokens)
        rare = (CLASSES - 1) * BUCKETS + (tokens >> U64(60)).astype(np.int64)
        return at, np.where(at >= 0, self.cell[at] if len(self.cell) else rare, rare)

    def features(self, tokens: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """Hashes of the three context features of each token."""
        one, two = np.zeros_like(tokens), np.zeros_like(tokens)
        one[1:], two[2:] = tokens[:-1], tokens[:-2]
        starts = off[:-1]
        one[starts] = two[starts] = U64(0)
        second = starts + 1
        second = second[second < off[1:]]
        two[second] = U64(0)
        return [mix(one + U64(1)), mix(one * U64(3) ^ mix(two + U64(2))), mix(two + U64(5))]

    def rows(self, features: list[np.ndarray], klass: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        k, top = klass.astype(np.uint64) * U64(0x9E3779B97F4A7C15), U64(64 - self.bits)
        return [(f >> top).astype(np.int64) for f in features], [(mix(f + k) >> top).astype(np.int64) for f in features]

    @staticmethod
    def powers(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """e to each logit (within +-LOGIT, so that no sum of them overflows or vanishes), and the rows' sums."""
        np.clip(z, -LOGIT, LOGIT, out=z)
        np.exp(z, out=z)
        return z, z @ ONES

    def predict(self, w: np.ndarray, rows: tuple, klass: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Shares of classes and of buckets, each before they are divided by the sums beside them."""
        out = []
        for level, prior in ((0, self.class_prior), (1, self.bucket_prior.take(klass, 0))):
            z = w[level].take(rows[level][0], 0)
            for r in rows[level][1:]:
                z += w[level].take(r, 0)
            z += prior
            out.append(self.powers(z))
        return out

    def score(self, tokens: np.ndarray, off: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """log10 of both softmaxes' shares, less the spread of the cell, of each token."""
        out = np.empty(len(tokens))
        f = self.features(tokens, off)
        for a in range(0, len(tokens), BATCH):
            part = slice(a, a + BATCH)
            klass, bucket = cell[part] >> 4, cell[part] & 15
            (p, p_sum), (q, q_sum) = self.predict(self.weights, self.rows([x[part] for x in f], klass), klass)
            i = np.arange(len(klass))
            share = (p[i, klass] / p_sum.astype(np.float64)) * (q[i, bucket] / q_sum.astype(np.float64))
            out[part] = np.log10(share) - self.spread[cell[part]]
        return out

    def train(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One pass over a task's texts; yields its changes and how often it met each row, cut by rows."""
        w, seen = self.weights.copy(), np.full(self.weights.shape[:2], 1e-2, np.float32)
        met = np.zeros(self.weights.shape[:2], np.float32)
        n = 0
        for batch in batches:
            for _, _, tokens, off in _tokens(batch.column(0)):
                cell = self.cells(tokens)[1]
                f = self.features(tokens, off)
                n += len(tokens)
                for a in range(0, len(tokens), BATCH):
                    part = slice(a, a + BATCH)
                    klass, bucket = cell[part] >> 4, cell[part] & 15
                    rows = self.rows([x[part] for x in f], klass)
                    i = np.arange(len(klass))
                    for level, ((g, total), target) in enumerate(zip(self.predict(w, rows, klass), (klass, bucket))):
                        g /= total[:, None]
                        g[i, target] -= 1
                        for r in rows[level]:
                            _step(w[level], seen[level], met[level], r, g)
        if n:
            w -= self.weights
            change, times = w.reshape(-1, PART, CLASSES), met.reshape(-1, PART)
            some = np.flatnonzero(times.any(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array([times[i].tobytes() for i in some], pa.binary()), pa.array([change[i].astype(np.float16).tobytes() for i in some], pa.binary())],
                ["part", "met", "change"],
            )


#: Rows of weights whose changes are sent together.
PART = 256


def _step(w: np.ndarray, seen: np.ndarray, met: np.ndarray, rows: np.ndarray, g: np.ndarray) -> None:
    """Gradient update of the rows met, each by its own rate (that falls with the squares it has seen)."""
    key = (rows << PLACE_BITS) | np.arange(len(rows))  # in the order of rows, and of places within one
    key.sort()
    r = key >> PLACE_BITS
    at = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    total = np.add.reduceat(g.take(key & (BATCH - 1), 0), at, axis=0)
    own, size = r[at], np.concatenate([at[1:], [len(r)]]) - at
    met[own] += size
    squares = seen[own] + np.einsum("ij,ij->i", total, total) / CLASSES
    seen[own] = squares
    total *= (-RATE / np.sqrt(squares))[:, None]
    total += w.take(own, 0)
    w[own] = total


def _average(table: pa.Table) -> pa.Table:
    met, x = np.zeros(PART), np.zeros((PART, CLASSES))
    for c, m in zip(table.column("change"), table.column("met")):
        n = np.frombuffer(m.as_buffer(), np.float32)
        met += n
        x += n[:, None] * np.frombuffer(c.as_buffer(), np.float16).reshape(PART, CLASSES)
    x /= np.maximum(met, 1)[:, None]
    return pa.table({"part": table.column("part")[:1], "met": pa.array([met.astype(np.float32).tobytes()], pa.binary()), "change": pa.array([x.astype(np.float16).tobytes()], pa.binary())})


def _rounds(changes: DataFrame, tasks: int) -> DataFrame:
    """Weighted average of the tasks' changes, at most about FAN_IN at a time."""
    groups = tasks
    cut = changes.withColumn("group", F.spark_partition_id())
    while True:
        groups = -(-groups // FAN_IN)
        cut = cut.withColumn("group", F.pmod("group", F.lit(groups)))
        cut = cut.groupBy("part", "group").applyInArrow(
            lambda t: _average(t).append_column("group", t.column("group")[:1]), "part int, met binary, change binary, group int"
        )
        if groups == 1:
            return cut


def held_out(id_col: str):
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: float = MIN_SHARE, passes: int = 1) -> tuple[Model, DataFrame, int]:
    """The model, the table of counts by range, and the number of ranges."""
    text = F.col(f"`{text_col}`").cast("string").alias("text")
    own = docs.where(~held_out(id_col)).select(text)
    chars = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    ranges = max(1, -(-int(0.4 * chars) // RANGE_BYTES))
    counts = written(
        own.mapInArrow(lambda it: _count(it, ranges), PACKED).groupBy("range").applyInArrow(_merge, "range int, words long, tokens long, packed binary"),
        "counts",
    )
    total = counts.agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).first()
    tokens = int(total["tokens"] or 0)
    least = max(1, math.ceil(tokens * min_share))
    # bounded: 1 / min_share words of 16 bytes at most in 64 rows, and 16 rows of sums
    found = counts.select("range", "packed").groupBy(F.pmod("range", F.lit(64))).applyInArrow(lambda t: _frequent(t, least), "often binary").toArrow()
    often = _unpack(found.column("often"), 2)
    rest = counts.select("packed").mapInArrow(lambda it: _rare(it, least), "bucket long, mass long, words long")
    rest = rest.groupBy("bucket").agg(F.sum("mass").alias("mass"), F.sum("words").alias("words")).orderBy("bucket").collect()
    rare = [np.array([r[c] for r in rest] or [0] * BUCKETS, np.int64) for c in ("mass", "words")]
    model = Model(often[:, 0].copy(), often[:, 1].copy().view(np.int64), *rare, tokens, int(total["words"] or 0))
    for _ in range(passes):
        spark = docs.sparkSession
        shared = spark.sparkContext.broadcast(model)  # bounded by min_share and MAX_ROWS
        changes = own.mapInArrow(lambda it: shared.value.train(it), "part int, met binary, change binary")
        done = _rounds(changes, own.rdd.getNumPartitions()).select("part", "change").collect()  # as large as the weights
        flat = model.weights.reshape(-1, PART, CLASSES)
        for r in done:
            flat[r["part"]] += np.frombuffer(r["change"], np.float16).reshape(PART, CLASSES)
    return model, counts, ranges


def _first_score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Sums of every text over the tokens that the model's table has, and the others' words."""
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 33
    known_score = np.log10(model.counts.astype(np.float64) + 1)
    for batch in batches:
        for first, n, tokens, off in _tokens(batch.column(2)):
            at, cell = model.cells(tokens)
            there = at >= 0
            add = lambda x: np.add.reduceat(x, off[:-1]) if n else x  # noqa: E731  every text has a token
            numerator = np.zeros(len(tokens))
            numerator[there] = known_score[at[there]]
            rare = np.zeros(0, U64) if model.complete else tokens[~there]
            cut = np.zeros(n + 1, np.int64) if model.complete else np.concatenate([[0], np.cumsum(add((~there).astype(np.int64)))])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + n)),
                    batch.column(0).slice(first, n),
                    batch.column(1).slice(first, n),
                    pa.array(np.diff(off)),
                    pa.array(add(there.astype(np.int64))),
                    pa.array(add(numerator)),
                    pa.array(add(model.score(tokens, off, cell))),
                    pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(rare.view(np.int64))),
                ],
                ["row", "doc_id", "held_out", "n_tokens", "known", "counted", "shares", "rare"],
            )
            row += n


def _pack_rare(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, lists = batch.column(0).to_numpy(), batch.column(1)
        h = lists.flatten().to_numpy(zero_copy_only=False).view(U64)
        if not len(h):
            continue
        size = np.diff(lists.offsets.to_numpy())
        key = np.stack([h, np.repeat(rows, size).view(U64)], 1)
        order = np.lexsort((key[:, 1], key[:, 0]))
        key = key[order]
        at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
        yield _by_range(ranges, 1, key[at, 0].copy(), key[at, 1].copy().view(np.int64), np.diff(at, append=len(key)))


def _look_up(table: pa.Table, ranges: int) -> pa.Table:
    """What the rows that ask one range for words get, packed by ranges of the rows' hashes."""
    kind = table.column("kind").to_numpy()
    packed = table.column("packed")
    counts = _unpack([packed[int(i)] for i in np.flatnonzero(kind == 0)], 2)
    asked = _unpack([packed[int(i)] for i in np.flatnonzero(kind == 1)], 3)
    at = lookup(counts[:, 0].copy(), asked[:, 0].copy())
    hit = asked[at >= 0]
    times, c = hit[:, 2].astype(np.int64), counts[at[at >= 0], 1].astype(np.float64)
    rows, inverse = np.unique(hit[:, 1].copy(), return_inverse=True)
    known, counted = (np.bincount(inverse, x, minlength=len(rows)) for x in (times, times * np.log10(c + 1)))
    key = mix(rows)
    order = np.argsort(key)
    columns = rows.view(np.int64)[order], known[order], counted.astype(np.float64)[order].view(np.int64)
    return pa.Table.from_batches([_by_range(ranges, 2, key[order], *columns)])


def _sum_up(table: pa.Table) -> pa.Table:
    """The sums of one range of rows."""
    t = _unpack(table.column("packed"), 4)
    rows, inverse = np.unique(t[:, 1].copy().view(np.int64), return_inverse=True)
    known, counted = np.bincount(inverse, t[:, 2].astype(np.float64), minlength=len(rows)), np.bincount(inverse, t[:, 3].copy().view(np.float64), minlength=len(rows))
    return pa.table({"row": rows, "k": known.astype(np.int64), "s": counted.astype(np.float64)})


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    model, counts, ranges = fit(docs, id_col, text_col, min_share)
    shared = spark.sparkContext.broadcast(model)
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    first = written(
        d.mapInArrow(
            lambda it: _first_score(it, shared.value),
            "row long, doc_id long, held_out boolean, n_tokens long, known long, counted double, shares double, rare array<long>",
        ),
        "scores",
    )
    out = first.drop("rare")
    if not model.complete:
        asked = first.where(F.size("rare") > 0).select("row", "rare").mapInArrow(lambda it: _pack_rare(it, ranges), PACKED)
        more = (
            asked.union(counts.select("range", F.lit(0).alias("kind"), "packed"))
            .groupBy("range")
            .applyInArrow(lambda t: _look_up(t, ranges), PACKED)
            .groupBy("range")
            .applyInArrow(_sum_up, "row long, k long, s double")
        )
        out = out.join(more, "row", "left").withColumn("known", F.col("known") + F.coalesce("k", F.lit(0))).withColumn("counted", F.col("counted") + F.coalesce("s", F.lit(0.0)))
    spread = float(np.log10(model.tokens + model.types + 1))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("counted") - F.col("n_tokens") * F.lit(spread)).alias("base_score"),
        (F.col("shares") + F.col("counted")).alias("score"),
    )


def op9_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
