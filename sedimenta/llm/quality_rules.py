"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

A rule is a named boolean expression over one document's text that is true when
the document is to be rejected.  ``order_rules`` measures every rule on a bounded
sample: what it rejects, and its cost, the processor time that Spark counts
inside the tasks, least of several runs and less that of a rule that only reads
the text.  ``cascade`` then puts the rules, in order of rejections per unit of
cost, into one ``CASE WHEN`` chain, so that an expensive rule is evaluated only
for documents that every earlier rule let through.  The set of documents kept
does not depend on the order, only the work does.

``judged`` reports five counts of every document, so rules over these are nearly
free there; the others (words with letters, lines that break off) are evaluated
for documents that pass the rest.

Words are runs of characters other than space and U+0009 to U+000D.

Defined results: a null or empty text has no words, so it fails ``few_words``
and is rejected; a very long text is judged as a whole; null ids are carried as
they are; repeated rows are judged one by one; rules of like gain (within a
factor of 1.5 or so) keep the order given; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.shared import about

WS = r"[\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Rows, about, on which the cost and selectivity of the rules are estimated.
SAMPLE_ROWS = 1000
#: Times that every rule runs over the sample; gains within a step of this factor count as equal.
RUNS, STEP = 3, 1.5

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
MAX_SYMBOLS_PER_WORD = 0.25
MAX_DUP_LINE_SHARE = 0.6
MIN_MEAN_WORD, MAX_MEAN_WORD = 1.5, 40.0
#: Per cent of words that have a letter, and of lines that end in an ellipsis.
MIN_LETTER_PERCENT, MAX_ELLIPSIS_PERCENT = 50, 30
LETTER = r"[A-Za-z\x{80}-\x{10FFFF}]"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, even if body uses it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(values: Column, step) -> Column:
    """``step`` over all elements up to each one, by doubling: for an associative step that is commutative, like a sum or maximum."""

    def reach(acc: Column, j: Column) -> Column:
        back = lambda i: i - F.pow(F.lit(2.0), j).cast("int")
        return F.transform(acc, lambda x, i: F.when(back(i) >= 0, step(x, F.get(acc, back(i)))).otherwise(x))

    rounds = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int") - 1, F.lit(0)))
    return F.aggregate(rounds, values, reach)


def _clean(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text."""
    stripped = F.btrim(_clean(text), F.lit(WS_CHARS))
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, WS + "+", -1))


def n_words(text: Column) -> Column:
    return F.regexp_count(_clean(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def word_chars(text: Column) -> Column:
    """Code points inside words."""
    return F.length(F.translate(_clean(text), WS_CHARS, "")).cast("long")


def n_symbols(text: Column) -> Column:
    t = _clean(text)
    return (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long")


def _full_lines(text: Column) -> Column:
    return F.filter(F.split(_clean(text), "\n", -1), lambda x: F.length(F.btrim(x, F.lit(WS_CHARS))) > 0)


def n_letter_words(text: Column) -> Column:
    """Words with an ASCII letter or a character above U+007F."""
    return F.size(F.filter(words(text), lambda w: w.rlike(LETTER))).cast("long")


def _broken(line: Column) -> Column:
    end = F.rtrim(line, F.lit(WS_CHARS))
    return end.endswith("...") | end.endswith("\u2026")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(_full_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(word_array: Column, window: int = WINDOW) -> Column:
    """Words inside a window of ``window`` words that the text holds twice or more."""

    def windows(hashes: Column) -> Column:
        n = F.size(hashes) - (window - 1)
        return F.when(n < 2, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(hashes, i, window)))
        )

    def covered(w: Column) -> Column:
        placed = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(
            placed,
            lambda s: F.filter(
                s,
                lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
            ),
        )
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, i: F.struct((a["n"] + i + window - F.greatest(i, a["end"])).alias("n"), (i + window).alias("end")),
            lambda a: a["n"],
        )

    counted = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))
    return let(F.transform(word_array, lambda x: F.xxhash64(x)), lambda h: let(windows(h), counted)).cast("long")


@dataclass(frozen=True)
class Rule:
    name: str
    reject: Column


def default_rules(text: Column) -> list[Rule]:
    """The production rules, each an expression of the text alone."""
    n = n_words(text)
    return [
        Rule("few_words", n < MIN_WORDS),
        Rule("odd_word_length", (word_chars(text) < MIN_MEAN_WORD * n) | (word_chars(text) > MAX_MEAN_WORD * n)),
        Rule("symbols", n_symbols(text) > MAX_SYMBOLS_PER_WORD * n),
        Rule("dup_lines", let(_full_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x)) > MAX_DUP_LINE_SHARE * F.size(x))),
        Rule("repeats", let(words(text), lambda w: 100 * n_repeat_words(w) > MAX_REPEAT_PERCENT * F.size(w))),
        *text_rules(text),
    ]


def text_rules(text: Column) -> list[Rule]:
    """The rules that need more than the reported counts."""
    return [
        Rule("few_letters", 100 * n_letter_words(text) < MIN_LETTER_PERCENT * n_words(text)),
        Rule("ellipses", let(_full_lines(text), lambda x: 100 * F.size(F.filter(x, _broken)) > MAX_ELLIPSIS_PERCENT * F.size(x))),
    ]


def _measured(df: DataFrame) -> tuple[int, float]:
    """The one number of a one-row result, and the processor seconds that its tasks took."""
    sc = df.sparkSession.sparkContext
    before, group = sc.getLocalProperty("spark.jobGroup.id"), uuid.uuid4().hex
    sc.setLocalProperty("spark.jobGroup.id", group)
    try:
        value = df.first()[0] or 0
    finally:
        sc.setLocalProperty("spark.jobGroup.id", before)
    scala = sc._jsc.sc()
    scala.listenerBus().waitUntilEmpty()
    tracker, store, ns = sc.statusTracker(), scala.statusStore(), 0
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            known = tracker.getStageInfo(stage)
            if known and known.numCompletedTasks:
                ns += store.lastStageAttempt(stage).executorCpuTime()
    return value, ns / 1e9


def gains(sample: DataFrame, rules: list[Rule], runs: int = RUNS, text_col: str = "text") -> list[float]:
    """Rejections per second of each rule on the sample; every rule sees all of it."""

    def cost(reject: Column) -> tuple[int, float]:
        job = sample.agg(F.sum(F.coalesce(reject, F.lit(False)).cast("int")).alias("n"))
        seen = [_measured(job) for _ in range(runs)]
        return seen[0][0], min(s for _, s in seen)

    idle = cost(F.length(F.col(f"`{text_col}`")) < 0)[1]
    return [n / max(s - idle, 1e-4) for n, s in (cost(r.reject) for r in rules)]


def in_order(rules: list[Rule], gain: list[float], step: float = STEP) -> list[Rule]:
    """Rules by gain, best first; those of one step of a geometric scale keep their order, those that reject nothing are last."""
    scale = [math.floor(math.log(g, step)) if g > 0 else -math.inf for g in gain]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -scale[i])]


def order_rules(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS, text_col: str = "text", id_col: str | None = None) -> list[Rule]:
    """Rules by rejections per second on about ``sample_rows`` different texts (or ids with texts), best first."""
    sample = about(docs, sample_rows, [text_col] if id_col is None else [id_col, text_col]).select(F.col(f"`{text_col}`").cast("string").alias(text_col)).cache()
    try:
        return in_order(rules, gains(sample, rules, text_col=text_col)) if sample.count() else list(rules)
    finally:
        sample.unpersist()


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(r.reject, F.lit(r.name)).otherwise(out)
    return out


def keep(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS, id_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns unchanged."""
    ordered = order_rules(docs, rules or default_rules(F.col(f"`{text_col}`")), sample_rows, text_col, id_col)
    return docs.where(cascade(ordered).isNull())


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, the five counts and the number of lines with a word of every row."""
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    text = F.col("text")
    per_words = let(
        words(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), n_repeat_words(w).alias("n_repeat_words")),
    )
    lines = let(
        _full_lines(text),
        lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")),
    )
    return base.select(
        "doc_id",
        "text",
        per_words.alias("w"),
        word_chars(text).alias("word_chars"),
        n_symbols(text).alias("n_symbols"),
        lines.alias("l"),
    ).select(
        "doc_id", "text", "w.n_words", "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), "w.n_repeat_words", F.col("l.n").alias("n_lines")
    )


def measured_rules() -> list[Rule]:
    """The same rules over the columns of ``measures``, where they have what a rule needs."""
    c = F.col
    return [
        Rule("few_words", c("n_words") < MIN_WORDS),
        Rule("odd_word_length", (c("word_chars") < MIN_MEAN_WORD * c("n_words")) | (c("word_chars") > MAX_MEAN_WORD * c("n_words"))),
        Rule("symbols", c("n_symbols") > MAX_SYMBOLS_PER_WORD * c("n_words")),
        Rule("dup_lines", c("n_dup_lines") > MAX_DUP_LINE_SHARE * c("n_lines")),
        Rule("repeats", 100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words")),
        *text_rules(c("text")),
    ]


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every document.

    The counts are all asked for, so each is computed, and rules over them cost
    what comparing numbers does; the cascade's order is learned on a sample of
    rows that have their counts, and saves the rules that read the text again.
    """
    counted = measures(about(docs, sample_rows, [id_col, text_col]), id_col, text_col).cache()
    rules = measured_rules()
    try:
        rules = in_order(rules, gains(counted, rules)) if counted.count() else rules
    finally:
        counted.unpersist()
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measures(docs, id_col, text_col).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & cascade(rules).isNull()).alias("kept"),
    )


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
x AS (SELECT doc_id, ws, i, list_slice(ws, i, i + {WINDOW - 1}) AS win
      FROM w, unnest(range(1, greatest(len(ws) - {WINDOW - 2}, 1))) AS u(i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM x),
p AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM r WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
      , count(*) FILTER (WHERE regexp_matches(line, '(\.\.\.|\x{{2026}})[\x20\x09-\x0D]*\z')) AS broken
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
      (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      coalesce(l.dup, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n, 0) AS n_lines,
      coalesce(l.broken, 0) AS broken, len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z\x{{80}}-\x{{10FFFF}}]'))) AS letters
      FROM w LEFT JOIN p USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < {MIN_MEAN_WORD} * n_words OR word_chars > {MAX_MEAN_WORD} * n_words
       OR n_symbols > {MAX_SYMBOLS_PER_WORD} * n_words OR n_dup_lines > {MAX_DUP_LINE_SHARE} * n_lines
       OR 100 * letters < {MIN_LETTER_PERCENT} * n_words OR 100 * broken > {MAX_ELLIPSIS_PERCENT} * n_lines) AS kept
FROM b"""
