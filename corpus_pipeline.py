"""A corpus from documents in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and reads it again as the next
stage's documents.  All but the last return the columns of documents; ``n_chars``
follows the text where a stage changes it.

1. ``quality_rules``: rejected documents go.
2. ``line_dedup``: later copies of maximal runs of two lines or more go, and of single
   lines of ``LONG_WORDS`` words or more; a document that has no line left goes,
   unless it had none to lose.
3. ``ngram_join``: of every component of similar documents (sets of five-word
   shingles with a Jaccard similarity of 0.8 at least) the one of least id stays
   (one row of a text, if rows repeat); documents without words or id stay.
4. ``decontaminate``: documents that share a window of words with a benchmark
   item go.
5. ``byte_bpe``: the documents left are encoded; the last result has doc_id,
   n_tokens and digests of the ids and of what they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import byte_bpe, decontaminate, line_dedup, ngram_join, quality_rules
from sedimenta.llm.shared import written

#: Words of a line whose later copies go without a neighbour.
LONG_WORDS = 50
#: Words of a shingle and least similarity in per cent of near copies; op7's query has its own.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.without_repeats(docs, long_words=LONG_WORDS)
    left = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    changed = F.col("n_removed") > 0
    own = lambda c: F.col("row").getField(c)  # noqa: E731  the row stays apart, so its names cannot clash
    columns = {"text": F.when(changed, F.col("kept")).otherwise(own("text"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(own("n_chars"))
    return left.select(*(columns.get(c, own(c)).alias(c) for c in docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_components(docs, n=NEAR_WORDS, percent=NEAR_PERCENT, with_hash=True).where("n_links > 0 AND doc_id IS NOT NULL")
    key = [F.col("doc_id"), F.col("text_hash")]
    gone = found.where("doc_id <> component_id").select(*key).distinct()
    again = found.where("doc_id = component_id").groupBy(*key).count().where("count > 1").select(*key)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    left = rows.join(gone, ["doc_id", "text_hash"], "left_anti")
    own = [F.col("row").getField(c).alias(c) for c in docs.columns]
    if again.isEmpty():
        return left.select(*own)
    once = left.join(again, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    return left.join(again, ["doc_id", "text_hash"], "left_anti").union(once.select(*left.columns)).select(*own)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode_report(docs, public_tokenizers.path(byte_bpe.VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_join", near_stage),
    ("decontaminate", benchmark_stage),
    ("byte_bpe", token_stage),
]

#: The last stage's ids and digests of ids are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return stage_result(spark, docs, sf_dir)


def stage_result(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return written(STAGES[-1][1](spark, docs, sf_dir), f"stage-{STAGES[-1][0]}")


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
