"""Grouped aggregation over several fields at once, calendar buckets, and regrouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.times import bucket


def by_bucket(df: DataFrame, time: str, unit: str, aggregates: list[Column], keys: list[str] = (), name: str = "bucket") -> DataFrame:
    """Aggregates by calendar bucket and any other keys; nulls are a group of their own."""
    return df.groupBy(bucket(unit, F.col(time)).alias(name), *keys).agg(*aggregates)


def field_terms(df: DataFrame, fields: list[str], aggregates: list[Column], group: Column | None = None) -> DataFrame:
    """(field, term, group, aggregates) for several fields in one pass over the rows.

    Rows are unpivoted after projection, so one partial aggregation serves all
    fields.  A null term is left out, as is a row whose group is null or 0.
    """
    g = F.lit(1) if group is None else group
    own = df.withColumn("group", g).where(F.col("group").isNotNull() & (F.col("group") != 0))
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("term")) for f in fields))
    return (
        own.withColumn("__pair", F.explode(pairs))
        .select("*", "__pair.field", "__pair.term")
        .where("term IS NOT NULL")
        .groupBy("field", "term", "group")
        .agg(*aggregates)
    )


def regroup(df: DataFrame, rules: list[tuple[Column, int]]) -> DataFrame:
    """``group`` by the first rule that holds, 0 for none."""
    out = F.lit(0)
    for rule, number in reversed(rules):
        out = F.when(rule, F.lit(number)).otherwise(out)
    return df.withColumn("group", out)


def merged(parts: list[DataFrame], keys: list[str], sums: list[str] = (), mins: list[str] = (), maxs: list[str] = ()) -> DataFrame:
    """Partial results of several runs as one: sums add up, extremes combine, nulls change nothing."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums), *(F.min(c).alias(c) for c in mins), *(F.max(c).alias(c) for c in maxs))
