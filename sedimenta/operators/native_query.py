"""The native query: filters, one aggregate of some metrics, whole shards by time; and its text."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.errors import QueryError
from sedimenta.functions.times import parse_bound
from sedimenta.operators.filters import Clause, condition, parse
from sedimenta.schema import SHARD, STRING, DatasetSchema
from sedimenta.sources.dataset import Dataset

AGGREGATES = ("sum", "min", "max", "avg")


@dataclass(frozen=True)
class Metric:
    """What one pass finds for a metric: its sum is exact beyond 64 bits, and 0 for nothing."""

    name: str
    sum: int
    min: int | None
    max: int | None
    count: int

    def value(self, aggregate: str) -> str:
        if aggregate == "sum":
            return str(self.sum)
        if aggregate == "avg":
            return f"{self.sum / self.count:.2f}" if self.count else "n/a"
        found = getattr(self, aggregate)
        return "n/a" if found is None else str(found)


@dataclass(frozen=True)
class Result:
    source: str
    window: tuple[int | None, int | None] | None
    shards: int
    num_docs: int
    matched: int
    clauses: tuple[Clause, ...]
    aggregate: str
    metrics: tuple[Metric, ...]


def window_of(start: str | None, end: str | None) -> tuple[int, int] | None:
    """Closed window of epoch seconds; a bare end date stands for its last second."""
    if start is None and end is None:
        return None
    lo = -(2**63) if start is None else parse_bound(start)
    hi = 2**63 - 1 if end is None else parse_bound(end, end_of_day=True)
    if lo > hi:
        raise QueryError("the window begins after its end")
    return lo, hi


def aggregated(df: DataFrame, schema: DatasetSchema, metrics: list[str], clauses: list[Clause]) -> DataFrame:
    """One row: num_docs, matched, and for every metric its sum, min, max and count over the rows that match."""
    twice = {m for m in metrics if metrics.count(m) > 1}
    if twice:
        raise QueryError(f"named twice: {', '.join(sorted(twice))}")
    for m in metrics:
        try:
            kind = schema.field(m).kind
        except KeyError:
            raise QueryError(f"unknown field: {m}") from None
        if kind == STRING:
            raise QueryError(f"{m} is a string and cannot be aggregated")
    hit = F.lit(True)
    for c in clauses:
        hit = hit & condition(c, schema)
    hit = F.coalesce(hit, F.lit(False))
    out = [F.count("*").alias("num_docs"), F.count_if(hit).alias("matched"), F.count_distinct(SHARD).alias("shards") if SHARD in df.columns else F.lit(1).alias("shards")]
    for m in metrics:
        v = F.when(hit, F.col(f"`{m}`"))
        out += [
            F.coalesce(F.sum(v.cast("decimal(28,0)")), F.lit(0).cast("decimal(38,0)")).cast("decimal(38,0)").alias(f"{m}_sum"),
            F.min(v).alias(f"{m}_min"),
            F.max(v).alias(f"{m}_max"),
            F.count(v).alias(f"{m}_count"),
        ]
    return df.agg(*out)


def run(dataset: Dataset, metrics: list[str], filters: list[str] = (), aggregate: str = "sum", start: str | None = None, end: str | None = None) -> Result:
    if aggregate not in AGGREGATES:
        raise QueryError(f"an aggregate is one of {', '.join(AGGREGATES)}")
    window = window_of(start, end)
    clauses = [parse(f) for f in filters]
    df = dataset.stored() if window is None else dataset.whole_shards(*window)
    row = aggregated(df, dataset.schema, list(metrics), clauses).first()
    found = tuple(Metric(m, int(row[f"{m}_sum"]), row[f"{m}_min"], row[f"{m}_max"], row[f"{m}_count"]) for m in metrics)
    return Result(dataset.root, window, row["shards"], row["num_docs"], row["matched"], tuple(clauses), aggregate, found)


def _moment(seconds: int) -> str:
    if abs(seconds) >= 2**62:
        return "-inf" if seconds < 0 else "+inf"
    return datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def render(r: Result) -> str:
    """The result as text for a terminal; passwords in the source's address are hidden."""
    lines = [f"dataset:  {re.sub(r'//[^/@]*@', '//***@', r.source)}"]
    if r.window:
        lines.append(f"range:    {_moment(r.window[0])} .. {_moment(r.window[1])}")
    if not r.shards:
        return "\n".join([*lines, "no shards found"])
    lines.append(f"shards:   {r.shards} scanned")
    if r.clauses:
        lines += [f"filter:   {c}" for c in r.clauses]
        lines.append(f"matched:  {r.matched} / {r.num_docs} docs")
    else:
        lines.append(f"matched:  all {r.num_docs} docs")
    wide = max((len(m.name) for m in r.metrics), default=0) + 1
    lines += [f"{m.name + ':':<{wide}}   {r.aggregate} = {m.value(r.aggregate)}" for m in r.metrics]
    return "\n".join(lines)
