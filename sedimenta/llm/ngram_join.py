"""N-gram Jaccard join as a blocked sparse matrix product of documents by n-grams.

Two documents link when the Jaccard similarity of their sets of word n-grams is
at least ``percent`` / 100.

1. Documents with equal sets are one row of the incidence matrix; the smallest
   id stands for them.
2. Blocking loses no link.  Similar sets of at most m n-grams differ in at most
   H(m) = floor(2 m (100 - p) / (100 + p)) of them.  Every set is dealt, by the
   leading bits of its n-grams' hashes, into K(m) > H(m) parts, so two similar
   sets agree in K - H whole parts at least.  A set is dealt for each K that a
   partner no smaller than it may use.  A part's name is the mixed sum of its
   hashes.  Parts are ranked by their number of uncommon n-grams, by that of all,
   then by name, alike in every set that has them; a set sends its H + 1 highest
   alone, since the highest part that two similar sets agree in is among those of
   both.  Common n-grams are those that recur in a sample of ``SAMPLE`` texts:
   passages that many texts share would else join most of a large corpus into
   one block.  What the sample holds changes blocks, never links.
   Part names travel packed, by ranges of names; a task sends each name once,
   with the least set that has it, and links the others to that one.
3. Components of "agree in a part" are the blocks of rows.  Within a block the
   product of the rows with their transpose is taken over the columns that two
   rows have, row by row against the rows of fitting size; overlaps below the
   size-derived bound are discarded.  Blocks of many rows are cut and the cuts
   are multiplied pairwise in separate tasks.
4. Links are joined to components of classes, whose least id is then mapped back
   to documents.

All arithmetic on similarity is in integers.  Words: A-Z are lower-cased, a
word is a run of characters other than space and U+0009 to U+000D; a text of
fewer than ``n`` words has one n-gram, all of it.

Defined results: null, empty and wordless texts have no n-grams, link with
nothing and are their own component; a very long text is one row of the matrix;
rows that share an id are judged by their own texts, and only links make them
one component; a null id stands behind all others and its component is null
unless it links with a document that has an id; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.components import components
from sedimenta.llm.shared import about, trim, trimmed, written
from sedimenta.llm.wordhash import SPACED, U64, Block, blocks, mix

N, PERCENT = 4, 85
#: Bytes of part names that one task gathers, and of rows that one product takes a side.
RANGE_BYTES, CUT_BYTES, CUT_ROWS = 12 << 20, 8 << 20, 1024
#: Part names (16 bytes each) that a task holds before it sends them on.
HELD = 750_000
#: Texts whose recurring n-grams are common, and bits of a hash by which those are told.
SAMPLE, COMMON_BITS = 8192, 22
#: Documents that are looked up by sending their ids (24 bytes each) to every task.
BROADCAST_IDS = 200_000


def _sets(b: Block, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text of a block."""
    grams, size = b.grams(n), np.diff(b.off)
    short = b.whole(0) if (size < n).any() else None
    out = []
    for i, (a, k) in enumerate(zip(b.off.tolist(), size.tolist())):
        if k >= n:
            g = np.sort(grams[a : a + k - n + 1])
            out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        else:
            out.append(short[i : i + 1] if k else grams[:0])
    return out


def _digest(g: np.ndarray) -> tuple[np.uint64, np.uint64]:
    m = mix(g)
    return mix(np.array([m.sum() + U64(len(g)), mix(m ^ U64(0x5851F42D4C957F2D)).sum()], U64))


def differ(m: int, percent: int) -> int:
    """Most n-grams in which similar sets can differ if the larger has m."""
    return 2 * m * (100 - percent) // (100 + percent)


def parts(m: int, percent: int) -> int:
    h = differ(m, percent)
    return 1 << (h + h // 3).bit_length()


def levels(n: int, percent: int) -> list[int]:
    """Every K under which a set of n may meet a partner no smaller than it."""
    k, last = parts(n, percent), parts(100 * n // percent, percent)
    out = [k]
    while k < last:
        k *= 2
        out.append(k)
    return out


def _slots(g: np.ndarray) -> np.ndarray:
    return (mix(g ^ U64(0x6A09E667F3BCC909)) >> U64(64 - COMMON_BITS)).astype(np.int64)


def _sampled(batches: Iterator[pa.RecordBatch], n: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """The n-grams of each text, once a text, by ranges."""
    for batch in batches:
        for b in blocks(batch.column(0), SPACED, True):
            grams = np.sort(np.concatenate([np.zeros(0, U64), *_sets(b, n)]))
            at = np.append(np.searchsorted(grams, np.arange(ranges, dtype=U64) * U64((1 << 64) // ranges)), len(grams))
            cut = [grams[i:j].tobytes() for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(ranges, dtype=np.int32)), pa.array(cut, pa.binary())], ["range", "grams"])


def _recurring(table: pa.Table) -> pa.Table:
    """Slots of the n-grams of one range that two texts have."""
    grams, count = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), U64) for x in table.column("grams")]), return_counts=True)
    return pa.table({"slots": pa.array([np.unique(_slots(grams[count > 1])).astype(np.int32).tobytes()], pa.binary())})


def common_slots(d: DataFrame, n: int, ranges: int = 16) -> np.ndarray:
    """Which slots hold n-grams that recur in the sample: 2 ** COMMON_BITS bits, whatever the input."""
    cut = about(d, SAMPLE, ["text"]).mapInArrow(trimmed(lambda it: _sampled(it, n, ranges)), "range int, grams binary")
    found = cut.groupBy("range").applyInArrow(_recurring, "slots binary").toArrow()
    out = np.zeros(1 << COMMON_BITS, bool)
    for x in found.column("slots"):
        out[np.frombuffer(x.as_buffer(), np.int32)] = True
    return np.packbits(out)


def _names(g: np.ndarray, percent: int, common: np.ndarray) -> list[np.ndarray]:
    """Names of a set's parts."""
    n, mixed, out = len(g), mix(g ^ U64(0x2545F4914F6CDD1D)), []
    slots = _slots(g)
    rare = np.concatenate([[0], np.cumsum((common[slots >> 3] >> (7 - (slots & 7))) & 1 ^ 1)])
    most = (100 - percent) * (n + 100 * n // percent) // (100 + percent)
    for k in levels(n, percent):
        if k == 1:
            continue  # such sets are similar to equal ones only
        at = np.searchsorted(g, np.arange(k, dtype=U64) << U64(65 - k.bit_length()))
        size = np.diff(at, append=n)
        uncommon = np.diff(rare[at], append=rare[n])
        full = size > 0
        name = mix(np.arange(k, dtype=U64) + U64(k << 32))
        name[full] = mix(np.add.reduceat(mixed, at[full]) + name[full])
        out.append(name[np.lexsort((name, size, uncommon))[max(0, k - most - 1) :]])
    return out


def _per_document(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in blocks(batch.column(1), SPACED, True):
            sets = _sets(b, n)
            sizes = np.array([len(g) for g in sets], np.int64)
            d = np.array([_digest(g) for g in sets], U64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(b.first, b.n),
                    batch.column(2).slice(b.first, b.n),
                    batch.column(3).slice(b.first, b.n),
                    pa.array(sizes),
                    pa.array(d[:, 0].copy().view(np.int64)),
                    pa.array(d[:, 1].copy().view(np.int64)),
                    pa.array([sum(levels(int(s), percent)) for s in sizes], pa.int64()),
                ],
                ["doc_id", "text_hash", "rk", "n", "d1", "d2", "names"],
            )


def _star(names: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names, the least set of each, and edges from the other sets to it."""
    order = np.lexsort((who, names))
    names, who = names[order], who[order]
    first = np.ones(len(names), bool)
    first[1:] = names[1:] != names[:-1]
    hub = who[first][np.cumsum(first) - 1]
    other = who != hub
    return names[first], who[first], who[other], hub[other]


def _unique(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _packed(batches: Iterator[pa.RecordBatch], n: int, percent: int, ranges: int, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(range, edges?, pairs of 64-bit numbers) of the part names of whole batches."""
    held: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    count = 0

    def send() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        names, who, a, b = _star(np.concatenate(held), np.concatenate(owner))
        for edges, (x, y) in ((False, (names, who)), (True, _unique(a, b))):
            to = ((x >> U64(32)) * U64(ranges)) >> U64(32)
            order = np.argsort(to, kind="stable")
            to, x, y = to[order], x[order], y[order]
            at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
            if len(at):
                pairs = np.stack([x, y], 1)
                cut = [pairs[i:j].tobytes() for i, j in zip(at, [*at[1:], len(to)])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[at].astype(np.int32)), pa.array(np.full(len(at), edges)), pa.array(cut, pa.binary())], ["range", "edges", "pairs"]
                )

    for batch in batches:
        for b in blocks(batch.column(0), SPACED, True):
            for g in _sets(b, n):
                if len(g):
                    d = _digest(g)[0]
                    for x in _names(g, percent, common):
                        held.append(x)
                        owner.append(np.full(len(x), d, U64))
                        count += len(x)
            if count >= HELD:
                yield from send()
                held, owner, count = [], [], 0
    yield from send()


def _met(table: pa.Table) -> pa.Table:
    """Edges between the sets that share a part name of one range."""
    pairs = {e: [] for e in (False, True)}
    for e, x in zip(table.column("edges").to_pylist(), table.column("pairs")):
        pairs[e].append(np.frombuffer(x.as_buffer(), U64).reshape(-1, 2))
    a = b = np.zeros(0, U64)
    if pairs[False]:
        both = np.concatenate(pairs[False])
        _, _, a, b = _star(both[:, 0], both[:, 1])
    if pairs[True]:
        more = np.concatenate(pairs[True])
        a, b = np.concatenate([a, more[:, 0]]), np.concatenate([b, more[:, 1]])
        del more
    a, b = _unique(a, b)
    pairs.clear()
    trim()
    return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})


def _rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Sets of the texts whose digest is the one asked for, each once a task; columns: text, d1, d2, ..."""
    met: set = set()
    for batch in batches:
        want = np.stack([batch.column(i).to_numpy(zero_copy_only=False).view(U64) for i in (1, 2)], 1)
        for b in blocks(batch.column(0), SPACED, True):
            keep, sets = [], []
            for i, g in enumerate(_sets(b, n)):
                if len(g) and int(want[b.first + i, 0]) not in met and (_digest(g) == want[b.first + i]).all():
                    met.add(int(want[b.first + i, 0]))
                    keep.append(b.first + i)
                    sets.append(g.tobytes())
            own = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column(1), *own.columns[3:], pa.array(sets, pa.binary())], ["d1", *own.schema.names[3:], "grams"])


def product(sets: list[np.ndarray], weight: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Component label of each row and weighted number of links, over pairs of rows of different sides (side -1: all pairs)."""
    order = np.argsort([len(g) for g in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order])
    rows = np.repeat(np.arange(len(order)), size)
    _, columns, seen = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    shared = seen[columns] > 1  # other columns add to no overlap
    columns, rows = columns[shared], rows[shared]
    ptr = np.searchsorted(rows, np.arange(len(order) + 1))
    label, links = np.arange(len(order)), np.zeros(len(order), np.int64)
    mark = np.zeros(len(seen), np.int32)
    w, s = weight[order], side[order]
    for i in range(len(order) - 1):
        end = int(np.searchsorted(size, 100 * size[i] // percent, "right"))
        own = columns[ptr[i] : ptr[i + 1]]
        if end <= i + 1 or len(own) * (100 + percent) < 2 * percent * size[i]:
            continue
        mark[own] = 1
        total = np.concatenate([[0], np.cumsum(mark[columns[ptr[i + 1] : ptr[end]]])])
        at = ptr[i + 1 : end + 1] - ptr[i + 1]
        overlap = total[at[1:]] - total[at[:-1]]
        mark[own] = 0
        like = overlap * (100 + percent) >= percent * (size[i] + size[i + 1 : end])
        if s[i] >= 0:
            like &= s[i + 1 : end] != s[i]
        j = i + 1 + np.flatnonzero(like)
        if len(j):
            links[i] += w[j].sum()
            links[j] += w[i]
            olds = np.unique(label[np.append(j, i)])
            if len(olds) > 1:
                label[np.isin(label, olds)] = olds[0]
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return label[back], links[back]


def _multiply(table: pa.Table, percent: int) -> pa.Table:
    """Edges to the least class of each component and numbers of links, for every block among the rows."""
    ids, block, weight, side = (table.column(c).to_numpy() for c in ("d1", "block", "copies", "side"))
    grams = table.column("grams")
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    order = np.argsort(block, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
        _, once = np.unique(ids[own], return_index=True)  # rows may repeat
        own = own[once]
        if len(own) < 2:
            continue
        label, links = product([np.frombuffer(grams[int(i)].as_buffer(), U64) for i in own], weight[own], side[own], percent)
        least = np.full(len(own), np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids[own])
        linked = links > 0
        out.append((ids[own][linked], least[label][linked], links[linked]))
    a, b, c = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))
    trim()
    return pa.table({"a": a.astype(np.int64), "b": b.astype(np.int64), "links": c.astype(np.int64)})


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT, with_hash: bool = False
) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row, and if asked for text_hash, the text's xxhash64."""
    if not 1 <= percent <= 100:
        raise ValueError("percent is 1 to 100")
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    d = d.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.xxhash64("doc_id", "text").alias("rk"))
    per = written(d.mapInArrow(trimmed(lambda it: _per_document(it, n, percent)), "doc_id long, text_hash long, rk long, n long, d1 long, d2 long, names long"), "sets")
    # the least id, and one row that has the set
    classes = written(
        per.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.min("rk").alias("rk"), F.count("*").alias("copies"), F.first("n").alias("n")), "classes"
    )

    names = per.agg(F.sum("names").alias("s")).first()["s"] or 0
    ranges = max(1, -(-16 * names // RANGE_BYTES))
    common = d.sparkSession.sparkContext.broadcast(common_slots(d, n))  # bounded: 2 ** COMMON_BITS bits
    edges = (
        d.select("text")
        .mapInArrow(trimmed(lambda it: _packed(it, n, percent, ranges, common.value)), "range int, edges boolean, pairs binary")
        .groupBy("range")
        .applyInArrow(_met, "a long, b long")
    )
    near = components(edges)

    rows = classes.join(near.select(F.col("node").alias("d1"), F.col("component").alias("block")), "d1")
    sizes = rows.groupBy("block").agg(F.count("*").alias("rows"), F.sum("n").alias("grams"))
    sizes = sizes.where("rows > 1").select(
        "block", F.greatest(F.ceil(F.col("rows") / CUT_ROWS), F.ceil(F.col("grams") * 8 / CUT_BYTES)).cast("int").alias("cuts"), "grams"
    )
    sizes = written(sizes, "blocks")
    total = sizes.where("cuts = 1").agg(F.sum("grams").alias("s")).first()["s"] or 0
    bins = max(1, -(-8 * total // CUT_BYTES))
    rows = written(rows.join(sizes.drop("grams"), "block").select("rk", "d1", "d2", "block", "copies", "cuts"), "rows")
    want = F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows
    sets = (
        d.select("rk", "text")
        .join(want, "rk")
        .select("text", "d1", "d2", "block", "copies", "cuts")
        .mapInArrow(trimmed(lambda it: _rows(it, n)), "d1 long, block long, copies long, cuts int, grams binary")
    )
    # each cut meets every other once, and itself; rows are sent to as many tasks as there are cuts
    mine = F.pmod(F.xxhash64("d1"), F.col("cuts")).cast("int")
    other = F.explode(F.when(F.col("cuts") > 1, F.sequence(F.lit(0), F.col("cuts") - 1)).otherwise(F.array(F.lit(0))))
    dealt = sets.withColumn("mine", mine).withColumn("other", other)
    dealt = dealt.select(
        "d1",
        "block",
        "copies",
        "grams",
        F.when(F.col("mine") == F.col("other"), -1).otherwise((F.col("mine") > F.col("other")).cast("int")).alias("side"),
        F.when(F.col("cuts") > 1, F.xxhash64("block", F.least("mine", "other"), F.greatest("mine", "other"))).otherwise(F.pmod(F.xxhash64("block"), F.lit(bins))).alias("task"),
    )
    links = written(dealt.groupBy("task").applyInArrow(lambda t: _multiply(t, percent), "a long, b long, links long"), "links")

    joined = components(links.select("a", "b")).select(F.col("node").alias("d1"), "component")
    counts = links.groupBy(F.col("a").alias("d1")).agg(F.sum("links").alias("links"))
    least = classes.join(joined, "d1").groupBy("component").agg(F.min("first").alias("least"))
    named = (
        classes.join(joined, "d1", "left")
        .withColumn("component", F.coalesce("component", "d1"))  # no null is a key
        .join(least, "component", "left")
        .join(counts, "d1", "left")
        .select("d1", "d2", F.coalesce("least", "first").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    return (
        per.join(named, ["d1", "d2"], "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"),
            F.when(F.col("n") == 0, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"),
            *(["text_hash"] if with_hash else []),
        )
    )


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(ws, p, p + {N - 1}) AS g FROM d, unnest(range(1, greatest(len(ws) - {N - 2}, 2))) AS u(p) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= {PERCENT} * (x.n + y.n - i)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a),
k AS (SELECT a AS doc_id, count(*) AS links FROM l GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id))::BIGINT AS component_id, coalesce(k.links, 0)::BIGINT AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)"""
