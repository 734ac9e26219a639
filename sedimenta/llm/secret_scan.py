"""Secret scan: fixed patterns plus character Markov models, in DataFrame expressions only.

Base spans are the leftmost non-overlapping matches of three patterns.  Their
places come from the lengths of the pieces between and of the matches.

The method adds spans of kind ``markov``: tokens of at least ``MIN_TOKEN``
characters of the alphabet whose log-likelihood ratio under two first-order
character models, one of random strings and one of ordinary identifiers, is
high in total and per step.  Both models are trained from labelled samples
(token, label): random are the values of base matches and strings of digests of
numbers, ordinary are the words and long tokens of a sample of documents
outside base matches.  A token inside a base span is not named again.  Counting is distributed; what reaches the driver is one
table of bigrams of the alphabet (67 states by 66), whatever the input.

Defined results: a null text is empty and has no spans; a very long text is
scanned whole, in time n log n of its matches; spans that begin at one place are
in the order of their kinds; ids are carried, null or repeated; rows that repeat are scanned one by one; an empty table gives no
rows (and the models are then those of the generated strings alone); other
columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.quality_rules import let, scan as running
from sedimenta.llm.shared import about

#: Fixed patterns; ASCII letters of the first are matched in either case.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
#: All base matches at once.
BASE = f"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}|[0-9a-f]{{{MIN_HEX},}}|" + ASSIGN.replace("]+)", f"]{{{MIN_ASSIGN},}})")
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
START = len(ALPHABET)
MIN_TOKEN = 16
TOKEN = rf"[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}"

#: Documents, about, that train the models (told by a hash of id and text), and generated random strings.
TRAIN_DOCS, RANDOM_STRINGS = 2000, 2000
#: Total and per-step log-likelihood ratio (nats) from which a token is reported.
MIN_TOTAL, MIN_STEP = 12.0, 0.6


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _places(text: Column, pattern: str, kind: int, keep) -> Column:
    """Sorted array of (start, kind, end, value) of the matches of a pattern that ``keep`` lets through."""

    def placed(matches: Column) -> Column:
        empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
        steps = lambda pieces: F.transform(matches, lambda m, i: F.length(F.get(pieces, i)) + F.length(m))
        row = lambda m, end: F.struct((end - F.length(m)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m.alias("value"))
        # ends are running sums, so a text of many matches takes no more than its length
        sums = lambda p: running(steps(p), lambda a, b: a + b)
        rows = let(let(F.split(text, pattern, -1), sums), lambda ends: F.transform(matches, lambda m, i: row(m, F.get(ends, i))))
        return F.when(F.size(matches) == 0, empty).otherwise(F.filter(rows, lambda r: keep(r["value"])))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def base_spans(text: Column) -> Column:
    """(start, kind, end, value) of the base matches, by start, then kind."""
    t = _text(text)
    # runs of at least the least length are the runs of any length that pass, since nothing else can begin inside a run
    spans = F.concat(
        _places(t, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= MIN_ASSIGN),
        _places(t, f"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}", 1, lambda m: F.lit(True)),
        _places(t, f"[0-9a-f]{{{MIN_HEX},}}", 2, lambda m: F.lit(True)),
    )
    return F.array_sort(spans)


def _classes(token: Column) -> Column:
    """Index of each character in the alphabet."""
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def _bigrams(token: Column) -> Column:
    """Index pair of each step of a token, from the start state, as one number."""
    size = START + 1
    return let(_classes(token), lambda c: F.transform(c, lambda x, i: F.coalesce(F.get(c, i - 1), F.lit(START)) * size + x))


def labelled_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS, random_strings: int = RANDOM_STRINGS) -> DataFrame:
    """(token, label): 1 random, 0 ordinary, from about ``train_docs`` documents and generated strings."""
    spark = docs.sparkSession
    t = about(docs, train_docs, [id_col, text_col]).select(_text(F.col(f"`{text_col}`").cast("string")).alias("text")).select("text", base_spans(F.col("text")).alias("spans"))
    value = F.regexp_extract("s.value", r"([A-Za-z0-9+/_-]+)=*$", 1)
    known = t.select(F.explode("spans").alias("s")).select(value.alias("token"), F.lit(1).alias("label"))
    rest = F.regexp_replace("text", F.lit(BASE), F.lit(" "))
    plain = t.select(F.explode(F.regexp_extract_all(rest, F.lit(r"[A-Za-z][A-Za-z0-9_-]{3,}"), F.lit(0))).alias("token")).select("token", F.lit(0).alias("label"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    made = spark.range(random_strings).select(
        F.when(F.col("id") % 3 == 0, F.substring(digest, 1, 40))
        .when(F.col("id") % 3 == 1, F.regexp_replace(F.base64(F.unhex(digest)), "=", ""))
        .otherwise(F.upper(F.substring(F.translate(F.base64(F.unhex(digest)), "+/=", ""), 1, 24)))
        .alias("token"),
        F.lit(1).alias("label"),
    )
    return known.union(plain).union(made).where("token <> ''")


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio of every step, row by row of the bigram table; add-one smoothing."""
    size = START + 1
    steps = labelled.select("label", F.explode(_bigrams(F.col("token"))).alias("b")).where(F.col("b") % size >= 0)
    count = {(r["label"], r["b"]): r["n"] for r in steps.groupBy("label", "b").agg(F.count("*").alias("n")).collect()}
    out = []
    for a in range(size):
        total = [sum(count.get((k, a * size + b), 0) for b in range(START)) for k in (0, 1)]
        for b in range(size):
            p = [(count.get((k, a * size + b), 0) + 1) / (total[k] + START) for k in (0, 1)]
            out.append(math.log(p[1] / p[0]))
    return out


def _markov(text: Column, model: list[float]) -> Column:
    table = F.lit([float(x) for x in model]) if model else F.array()

    def ratio(m: Column) -> Column:
        return F.aggregate(_bigrams(m), F.lit(0.0), lambda a, b: a + F.get(table, b))

    def keep(m: Column) -> Column:
        return let(ratio(m), lambda r: (r >= MIN_TOTAL) & (r >= MIN_STEP * F.length(m)))

    return _places(_text(text), TOKEN, 3, keep)


def _named(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts and digest, and all spans of every row."""
    text = F.col(f"`{text_col}`").cast("string")
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), base_spans(text).alias("base"), _markov(text, model).alias("found"))
    inside = lambda m: F.exists("base", lambda s: (s["start"] <= m["start"]) & (s["end"] >= m["end"]))
    d = d.withColumn("more", F.filter("found", lambda m: ~inside(m)))  # what a base span holds adds nothing
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return d.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(_named(F.col("base")), 256).alias("base_sha256"),
        _named(F.array_sort(F.concat("base", "more"))).alias("spans"),
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, train(labelled_sample(docs)))
