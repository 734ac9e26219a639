"""Approximate aggregates, as expressions over Spark's sketches.

``approx_distinct`` is exact up to about 16 000 distinct values and within one
percent beyond, ``distinct`` exact for any number; ``theta`` gives mergeable sketches; ``approx_top_k`` is exact
in counts and in the order of ties.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sedimenta.errors import QueryError

DISTINCT_LG, THETA_ENTRIES = 14, 4096


def approx_distinct(c: str | Column) -> Column:
    """Estimated number of distinct values that are not null; 0 for none."""
    return F.call_function("theta_sketch_estimate", F.call_function("theta_sketch_agg", _col(c), F.lit(DISTINCT_LG)))


def distinct(c: str | Column) -> Column:
    """Number of distinct values that are not null: the sketch's where it holds all of them, else an exact count."""
    estimate = approx_distinct(c)
    return F.when(estimate < 1 << DISTINCT_LG, estimate).otherwise(F.count_distinct(_col(c)))


def lg_entries(entries: int) -> int:
    """log2 of a sketch's nominal entries, rounded up, within what Spark takes."""
    if entries < 1:
        raise QueryError("a sketch has one entry at least")
    return min(26, max(4, math.ceil(math.log2(entries))))


def theta(c: str | Column, entries: int = THETA_ENTRIES) -> Column:
    return F.call_function("theta_sketch_agg", _col(c), F.lit(lg_entries(entries)))


def theta_estimate(sketch: str | Column) -> Column:
    return F.call_function("theta_sketch_estimate", _col(sketch))


def theta_union(sketches: str | Column) -> Column:
    """Aggregate: the sketch of everything that a column of sketches has seen."""
    return F.call_function("theta_union_agg", _col(sketches))


def theta_intersect(a: str | Column, b: str | Column) -> Column:
    """Estimated number of values that both sketches have; null if either is null."""
    return theta_estimate(F.call_function("theta_intersection", _col(a), _col(b)))


def approx_percentile_cont(c: str | Column, p: float, centroids: int = 100) -> Column:
    """Percentile of an integer column as an integer; more centroids are more exact."""
    if not 0 <= p <= 1:
        raise QueryError("a percentile is from 0 to 1")
    return F.percentile_approx(_col(c), F.lit(float(p)), F.lit(max(100, centroids) * 100)).cast("bigint")


def percentile_cont(c: str | Column, p: float) -> Column:
    """Interpolated percentile, rounded to an integer."""
    return F.round(F.percentile(_col(c), F.lit(float(p)))).cast("bigint")


def top_k(df: DataFrame, c: str, k: int, by: list[str] | None = None, name: str = "top") -> DataFrame:
    """Per group the k most frequent values as an array of (value, count): count descending, value ascending.

    Counting is a partial and a final aggregation by group and value, so a hot
    group is spread over its values; only k rows of a task's share of a group
    go on to the step that orders whole groups.  Nulls do not count; a group of
    nulls alone has an empty array.
    """
    if k < 1:
        raise QueryError("k is one at least")
    by = by or []
    counted = df.groupBy(*by, F.col(f"`{c}`").alias("value")).agg(F.count("*").alias("count"))
    best = [F.col("count").desc(), F.col("value").asc()]
    salt = F.pmod(F.xxhash64("value"), F.lit(32))
    live = counted.where("value IS NOT NULL").withColumn("__salt", salt)
    # two limits: within a share of the group, then within the group
    some = live.withColumn("__r", F.row_number().over(W.partitionBy(*by, "__salt").orderBy(*best))).where(F.col("__r") <= k)
    rows = F.collect_list(F.struct((-F.col("count")).alias("n"), "value"))
    ordered = F.transform(F.slice(F.array_sort(rows), 1, k), lambda x: F.struct(x["value"].alias("value"), (-x["n"]).alias("count")))
    tops = some.groupBy(*by).agg(ordered.alias(name))
    if not by:
        return tops
    groups = counted.select(*by).distinct()
    same = [F.col(f"g.{b}").eqNullSafe(F.col(f"t.{b}")) for b in by]
    on = same[0]
    for s in same[1:]:
        on = on & s
    empty = F.array().cast(tops.schema[name].dataType)
    return groups.alias("g").join(tops.alias("t"), on, "left").select(*(F.col(f"g.{b}").alias(b) for b in by), F.coalesce(F.col(f"t.{name}"), empty).alias(name))


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c
