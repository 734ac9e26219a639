"""Line dedup with a suffix array over line ids, in DataFrame expressions only.

Every text is a sequence of lines.  The suffixes of all sequences are ranked by
distributed prefix doubling.  It begins with the first ``min_lines`` lines: the
distinct windows that occur twice or more are sorted by their lines' ids (their
hashes) and numbered.  A suffix's rank by its first 2k lines is that of the pair
(its rank by k lines, the rank of the suffix k lines on), and the distinct pairs
that occur twice or more are ranked by one range-partitioned sort.  A suffix
whose rank no other one has is final, so only suffixes that still share theirs
go on; the doubling stops when none do.

Suffixes of equal rank by k lines are an interval of the suffix array whose
longest common prefix is k lines at least; its earliest member (least id, then
position) is the copy that stays.  ``lcp`` of a suffix is the longest k whose
interval has an earlier member.  The maximal repeated runs of a text are the
unions of the lines [i, i + lcp) of its suffixes: a run of r lines has suffixes
with an lcp of the largest power of two within r at its front and so far from
its end, and both cover it.  These lines are deleted; repeats of fewer than
``min_lines`` lines stay.

If ``long_words`` is given, a line of that many words or more (a word is a run
of characters other than space and U+0009 to U+000D) is deleted alone too where
it also occurs earlier, and so is a later copy of a text that is one such line.
A document of several lines that this would leave without any loses what its
runs lose only.

Skew: texts that are equal as wholes are ranked once, through the least id;
windows and pairs are aggregated before they are shuffled, a common line alone
is no key of any join, a suffix finds the one k lines on by a join on sequence
and position, so that a long text is no key either, and ranks come from a sort's
row numbers, not from a window over all rows.  Texts themselves are shuffled
only where lines go.

Defined results: a null text stays null and has no lines; an empty text is one
empty line; empty lines count as lines; a very long text is one row, and its
runs are merged in time n log n; rows that share an id are told apart by their
text, and rows that repeat wholly are treated alike, as one document; a null id
stands behind all others; a copy of a text of ``min_lines`` lines or more loses
all its lines; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.quality_rules import let, scan
from sedimenta.llm.shared import drop, new_path, written

MIN_LINES = 2
#: Ids of documents that lose lines (8 bytes each) sent to every task at most; beyond it all documents are shuffled.
BROADCAST_IDS = 2_000_000
#: A sequence: whether its least id is null, that id (0 for null), and the text's hash, which tells apart what shares an id.
SEQ = ["nul", "id", "t1"]


def _ranked(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Rows with ``fresh``, increasing in their order: a range-partitioned sort's row numbers."""
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return distinct.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("fresh", F.monotonically_increasing_id())


def _windows(lines: Column, size: int) -> Column:
    """Array of (i, w1, w2, ids): every window of ``size`` lines, by hashes of it and by the ids of its lines."""
    n = F.size(lines) - (size - 1)

    def window(i: Column) -> Column:
        x = F.slice(lines, i + 1, size)
        return F.struct(i.alias("i"), F.xxhash64(x).alias("w1"), F.xxhash64(F.lit(7), x).alias("w2"), F.transform(x, lambda y: y["h1"]).alias("ids"))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), window))


def repeated_suffixes(windows: DataFrame, size: int = MIN_LINES) -> DataFrame:
    """(nul, id, t1, i, lcp) of every suffix whose first ``size`` lines also start earlier.

    ``windows`` has (nul, id, t1, i, w1, w2, ids): the windows of ``size`` lines
    of all sequences.  ``lcp`` is the longest of size, 2 size, 4 size, ... lines
    that the suffix shares with an earlier one.
    """
    spark = windows.sparkSession
    place = F.struct(*SEQ, "i")

    def numbered(rows: DataFrame, key: list[str], by: list[str], *more: Column) -> DataFrame:
        """The keys that two suffixes or more have: ``fresh`` and the earliest place."""
        shared = rows.groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("c"), *more).where("c > 1").drop("c")
        return written(_ranked(shared, by).select(*key, "first", "fresh"), "ranks")

    def put(rows: DataFrame) -> DataFrame:
        path = new_path(spark, "suffixes")
        rows.write.parquet(path)
        return spark.read.parquet(path)

    later = place > F.col("first")
    ranks = numbered(windows, ["w1", "w2"], ["ids", "w2"], F.first("ids").alias("ids"))
    now = put(windows.join(ranks, ["w1", "w2"]).select(*SEQ, "i", F.col("fresh").alias("rank"), later.alias("later"), F.lit(None).cast("int").alias("lcp")))
    k, rounds = size, [now]
    while True:
        open_ = now.where("rank IS NOT NULL")
        if open_.isEmpty():
            break
        there = open_.select(*SEQ, (F.col("i") - k).alias("i"), F.col("rank").alias("next"))
        pairs = written(open_.select(*SEQ, "i", "rank", "later").join(there, [*SEQ, "i"], "left"), "pairs")
        ranks = numbered(pairs.where("next IS NOT NULL"), ["rank", "next"], ["rank", "next"])
        met = pairs.join(ranks, ["rank", "next"], "left")
        again = F.coalesce(later, F.lit(False))
        # what is later by k lines, but not by 2k, is settled
        now = put(
            met.select(*SEQ, "i", F.col("fresh").alias("rank"), again.alias("again"), F.when(F.col("later") & ~again, F.lit(k)).alias("lcp"))
            .where("rank IS NOT NULL OR lcp IS NOT NULL")
            .withColumnRenamed("again", "later")
        )
        rounds.append(now)
        for used in (pairs, ranks):
            for f in used.inputFiles()[:1]:
                drop(spark, f.rsplit("/", 1)[0])
        k *= 2
    found = rounds[0]
    for r in rounds[1:]:
        found = found.union(r)
    return found.where("lcp IS NOT NULL").select(*SEQ, "i", "lcp")


def _without(lines: Column, runs: Column) -> Column:
    """The lines outside the runs, an array of (from, lines) sorted by from, from 0."""

    def gaps(x: Column, s: Column, end: Column) -> Column:
        def before(r: Column, j: Column) -> Column:
            since = F.coalesce(F.get(end, j - 1), F.lit(0))
            return F.slice(x, since + 1, F.greatest(r["i"] - since, F.lit(0)))

        last = F.element_at(end, -1)
        return F.concat(F.flatten(F.transform(s, before)), F.slice(x, last + 1, F.greatest(F.size(x) - last, F.lit(0))))

    ends = lambda s: scan(F.transform(s, lambda r: r["i"] + r["lcp"]), F.greatest)  # noqa: E731  of all runs so far
    return let(lines, lambda x: let(runs, lambda s: let(ends(s), lambda end: gaps(x, s, end))))


def _is_long(line: Column, words: int) -> Column:
    """Whether a line has that many words; short ones are not read for it."""
    return F.when(F.length(line) >= 2 * words - 1, F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")) >= words).otherwise(False)


def _later(lines: DataFrame) -> DataFrame:
    """(nul, id, t1, i) of the lines that also occur earlier."""
    place = F.struct(*SEQ, "i")
    first = lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1")
    return lines.join(first, ["h1", "h2"]).where(place > F.col("first")).select(*SEQ, "i")


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_lines: int = MIN_LINES,
    broadcast_ids: int = BROADCAST_IDS,
    long_words: int | None = None,
) -> DataFrame:
    """(row, n_lines, n_removed, kept) of every row: the row as a struct and the lines left (null if the text is null)."""
    if min_lines < 1 or long_words is not None and (min_lines > 2 or long_words < 1):
        raise ValueError("min_lines is 1 at least; long_words is 1 at least and goes with min_lines of 2 at most")
    text = F.col(f"`{text_col}`").cast("string")
    id_ = F.col(f"`{id_col}`").cast("long")
    d = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        id_.isNull().alias("nul"),
        F.coalesce(id_, F.lit(0)).cast("long").alias("id"),
        F.xxhash64(text).alias("t1"),
        F.xxhash64(F.lit(3), text).alias("t2"),
        F.split(text, "\n", -1).alias("lines"),
    )
    long = lambda x: [] if long_words is None else [_is_long(x, long_words).alias("long")]
    hashes = F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(7), x).alias("h2"), *long(x)))
    texts = written(
        d.where("lines IS NOT NULL").select("nul", "id", "t1", "t2", hashes.alias("l")).groupBy("t1", "t2").agg(F.min(F.struct("nul", "id")).alias("first"), F.first("l").alias("l")), "texts"
    )
    # the sequence's order is that of its least id; the text tells apart what shares an id
    seqs = texts.select("first.nul", "first.id", "t1", "l")
    bare = F.transform("l", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2")))
    windows = seqs.select(*SEQ, F.explode(_windows(bare, min_lines)).alias("x")).select(*SEQ, "x.*")
    found = repeated_suffixes(windows, min_lines).select(*SEQ, "i", "lcp", F.lit(False).alias("single"))
    whole_copy = F.size("lines") >= min_lines
    if long_words is not None:
        singles = seqs.select(*SEQ, F.posexplode("l").alias("i", "x")).where("x.long").select(*SEQ, "i", "x.h1", "x.h2")
        found = found.union(_later(singles).select(*SEQ, "i", F.lit(1), F.lit(True)))
        whole_copy |= (F.size("lines") == 1) & _is_long(F.get("lines", F.lit(0)), long_words)
    run = F.struct("i", "lcp")
    some = lambda x: F.when(F.size(x) > 0, F.array_sort(x))
    marks = found.groupBy(*SEQ).agg(some(F.collect_list(F.when(~F.col("single"), run))).alias("runs"), some(F.collect_list(run)).alias("all"), F.max("single").alias("singles"))
    marks = marks.withColumn("copy", F.lit(False))
    kinds = {f.name: f.dataType for f in marks.schema}
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    copies = d.where(whole_copy).select("nul", "id", "t1", "t2").join(texts.select("t1", "t2", "first"), ["t1", "t2"])
    copies = copies.where(F.struct("nul", "id") > F.col("first")).select(*SEQ, none("runs"), none("all"), none("singles"), F.lit(True).alias("copy"))
    marks = written(marks.union(copies.distinct()), "marks")

    size = F.coalesce(F.when(F.col("lines").isNotNull(), F.size("lines")), F.lit(0)).cast("long")
    whole = lambda x: x.select("row", size.alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.array_join("lines", "\n").alias("kept"))
    by_runs = F.when(F.col("runs").isNotNull(), _without(F.col("lines"), F.col("runs"))).otherwise(F.col("lines"))
    left = F.when(F.col("copy"), F.array().cast("array<string>"))
    if long_words is not None:
        by_all = _without(F.col("lines"), F.col("all"))
        left = left.when(F.col("singles"), let(by_all, lambda x: F.when((F.size("lines") == 1) | (F.size(x) > 0), x).otherwise(by_runs)))
    left = left.otherwise(by_runs)
    cut = lambda x: x.select("row", size.alias("n_lines"), left.alias("left")).select(
        "row", "n_lines", (F.col("n_lines") - F.coalesce(F.when(F.col("left").isNotNull(), F.size("left")), F.lit(0))).cast("long").alias("n_removed"), F.array_join("left", "\n").alias("kept")
    )
    named = marks.select("nul", "id").distinct()
    if named.count() > broadcast_ids:
        return cut(d.join(marks, SEQ, "left"))
    return whole(d.join(F.broadcast(named), ["nul", "id"], "left_anti")).union(cut(d.join(F.broadcast(named), ["nul", "id"], "left_semi").join(marks, SEQ, "left")))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 (lowercase hex of the lines left, joined by line feeds) of every row."""
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return without_repeats(own, min_lines=min_lines).select("row.doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS nx, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM l),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY line, nx ORDER BY doc_id, i) AS n FROM w WHERE j IS NOT NULL) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest([i, i + 1]) AS i FROM r),
k AS (SELECT l.doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS kept, count(g.i) AS gone
      FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n, 0)::BIGINT AS n_lines, coalesce(k.gone, 0)::BIGINT AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.kept, '')) END AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)"""
