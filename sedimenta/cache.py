"""Kept intermediate results: filtered rows that narrower filters start from, and rollups by shard."""

from __future__ import annotations

from collections import OrderedDict

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta import storage
from sedimenta.schema import SHARD
from sedimenta.sources.dataset import Dataset


class FilterCache:
    """Filtered frames by their set of predicates; the least recently used go first.

    A query that adds predicates to a kept set starts from the kept rows.  At
    most ``most`` frames are kept, and those of ``limit`` bytes by Catalyst's
    estimate; one that is larger alone is handed out and not kept.
    """

    def __init__(self, df: DataFrame, most: int = 8, limit: int | None = None):
        self.df, self.most, self.limit, self.kept = df, most, limit, OrderedDict()
        self.sizes: dict[frozenset, int] = {}
        self.hits = self.narrowed = self.misses = 0

    def where(self, *predicates: str) -> DataFrame:
        key = frozenset(predicates)
        if key in self.kept:
            self.hits += 1
            self.kept.move_to_end(key)
            return self.kept[key]
        wider = max((k for k in self.kept if k < key), key=len, default=None)
        self.narrowed += wider is not None
        self.misses += wider is None
        out = self.df if wider is None else self.kept[wider]
        for p in sorted(key - (wider or frozenset())):
            out = out.where(F.expr(p))
        size = int(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if self.limit is not None and size > self.limit:
            return out
        self.kept[key] = out = out.persist(StorageLevel.MEMORY_AND_DISK)
        self.sizes[key] = size
        while len(self.kept) > self.most or self.limit is not None and self.bytes > self.limit:
            self._drop()
        return out

    @property
    def bytes(self) -> int:
        return sum(list(self.sizes.values()))

    def _drop(self) -> None:
        key, df = self.kept.popitem(last=False)
        del self.sizes[key]
        df.unpersist()

    def clear(self) -> None:
        while self.kept:
            self._drop()


def write_rollup(dataset: Dataset, name: str, keys: list[str], sums: list[str]) -> DataFrame:
    """Counts and sums by shard and keys, stored beside the dataset; refreshing replaces whole shards."""
    path = f"{dataset.root}/_rollup_{name}"
    time = F.col(f"`{dataset.schema.time}`")
    parts = (
        dataset.stored()
        .groupBy(SHARD, *keys)
        .agg(F.count("*").alias("docs"), F.min(time).alias("min_time"), F.max(time).alias("max_time"), *(F.sum(c).alias(f"sum_{c}") for c in sums), *(F.count(c).alias(f"count_{c}") for c in sums))
    )
    parts.write.partitionBy(SHARD).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    return read_rollup(dataset, name)


def read_rollup(dataset: Dataset, name: str) -> DataFrame:
    return dataset.spark.read.parquet(f"{dataset.root}/_rollup_{name}")


def has_rollup(dataset: Dataset, name: str) -> bool:
    return storage.exists(dataset.spark, f"{dataset.root}/_rollup_{name}")


def from_rollup(rollup: DataFrame, keys: list[str], sums: list[str], where: Column | None = None) -> DataFrame:
    """Totals of any subset of a rollup's keys, from its partial results."""
    own = rollup if where is None else rollup.where(where)
    return own.groupBy(*keys).agg(F.sum("docs").alias("docs"), *(F.sum(f"sum_{c}").alias(f"sum_{c}") for c in sums), *((F.sum(f"sum_{c}") / F.sum(f"count_{c}")).alias(f"avg_{c}") for c in sums))
