"""Extension: joins on time, as-of and interval, that cut hot keys by slices of time.

Times are timestamps (then slices are in seconds) or numbers.  A row whose key
or time is null meets nothing.  Every key is cut into slices of ``width``, so a
key that a third of all rows share is many groups; what one task holds of a key
besides is one row a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a slice.
DAY = 86_400


def _slice(df: DataFrame, time: str, width: float) -> Column:
    at = F.col(f"`{time}`")
    if df.schema[time].dataType.typeName() in ("date", "timestamp", "timestamp_ntz"):
        at = at.cast("timestamp").cast("double")
    return F.floor(at / F.lit(width)).cast("long")


def _row(columns: list[str]) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in columns))


def _named(left: DataFrame, right: list[str], prefix: str) -> list[str]:
    names = [prefix + c for c in right]
    if both := set(names) & set(left.columns):
        raise ValueError(f"columns of both sides: {sorted(both)}; choose another prefix")
    return names


def _check(keys: list[str], width: float) -> None:
    if not keys:
        raise ValueError("at least one key")
    if width <= 0:
        raise ValueError("a slice is wider than 0")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, width: float = DAY, prefix: str = "right_") -> DataFrame:
    """Every row of ``left`` with the latest row of ``right`` of its keys that is not later than it, or nulls.

    Of several rows of ``right`` at one time the greatest is taken, by its columns
    in their order, which have to be orderable.  Rows meet by key and slice; the
    last row of every slice, aggregated before it is shuffled, is carried into the
    later slices of its key that have rows of ``left``.
    """
    _check(keys, width)
    own = [c for c in right.columns if c not in keys]
    names = _named(left, own, prefix)
    k = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)]
    key = [f"k{i}" for i in range(len(keys))]
    none = lambda kind: F.lit(None).cast(kind)
    lefts = left.select(*k, F.col(f"`{left_time}`").alias("t"), _slice(left, left_time, width).alias("slice"), _row(left.columns).alias("l"))
    rights = right.select(*k, F.col(f"`{right_time}`").alias("t"), _slice(right, right_time, width).alias("slice"), _row(own).alias("r")).dropna(subset=[*key, "t"])
    rights = rights.groupBy(*key, "slice", "t").agg(F.max("r").alias("r"))
    l_type, r_type = lefts.schema["l"].dataType, rights.schema["r"].dataType
    there = F.lit(True)
    for c in [*key, "t"]:
        there &= F.col(c).isNotNull()
    alone, asking = lefts.where(~there), lefts.where(there)

    last = rights.groupBy(*key, "slice").agg(F.max(F.struct("t", "r")).alias("last"))
    asked = asking.select(*key, "slice").distinct().withColumn("last", F.lit(None).cast(last.schema["last"].dataType))
    slices = last.union(asked).groupBy(*key, "slice").agg(F.max("last").alias("last"), F.max(F.col("last").isNull()).alias("asked"))
    before = Window.partitionBy(*key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select(*key, "slice", "asked", F.last("last", ignorenulls=True).over(before).alias("x")).where("asked AND x IS NOT NULL")

    rows = (
        asking.select(*key, "slice", "t", F.lit(1).alias("side"), "l", none(r_type).alias("r"))
        .union(rights.select(*key, "slice", "t", F.lit(0).alias("side"), none(l_type).alias("l"), "r"))
        .union(carried.select(*key, "slice", F.col("x.t").alias("t"), F.lit(0).alias("side"), none(l_type).alias("l"), F.col("x.r").alias("r")))
    )
    so_far = Window.partitionBy(*key, "slice").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.select("side", "l", F.last("r", ignorenulls=True).over(so_far).alias("r")).where("side = 1").select("l", "r")
    out = met.union(alone.select("l", none(r_type).alias("r")))
    return out.select("l.*", *(F.col("r").getField(c).alias(n) for c, n in zip(own, names)))


def within(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, start: str, end: str, width: float = DAY, prefix: str = "right_") -> DataFrame:
    """Pairs of rows of equal keys where ``start`` <= the time of ``left`` < ``end``.

    An interval goes to every slice that it touches, a row of ``left`` to one, so
    each pair is met once, by an equality join on keys and slice.  Choose
    ``width`` of about the usual length of an interval.
    """
    _check(keys, width)
    own = [c for c in right.columns if c not in keys]
    names = _named(left, own, prefix)
    k = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)]
    key = [f"k{i}" for i in range(len(keys))]
    lefts = left.select(*k, F.col(f"`{left_time}`").alias("t"), _slice(left, left_time, width).alias("slice"), _row(left.columns).alias("l"))
    spans = right.where(F.col(f"`{start}`") < F.col(f"`{end}`")).select(
        *k, F.col(f"`{start}`").alias("a"), F.col(f"`{end}`").alias("b"), F.explode(F.sequence(_slice(right, start, width), _slice(right, end, width))).alias("slice"), _row(own).alias("r")
    )
    met = lefts.join(spans, [*key, "slice"]).where("a <= t AND t < b")
    return met.select("l.*", *(F.col("r").getField(c).alias(n) for c, n in zip(own, names)))
