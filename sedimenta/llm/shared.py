"""Folder that driver and executors share, for written tables and checkpoints."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only on a local master, where it may be unset, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sedimenta-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The same rows as a table in the shared folder: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def trim() -> None:
    """Hand freed memory back; a Python worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # where there is no glibc
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that ends with ``trim``."""

    def run(it: Iterator) -> Iterator:
        yield from f(it)
        trim()

    return run


def about(docs: DataFrame, rows: int, columns: list[str]) -> DataFrame:
    """``columns`` of about ``rows`` rows that differ in them, told by a hash; of all if there are no more rows.

    Rows that agree in all columns are one, so neither nulls nor a text that a
    third of all rows share can fill the sample; 2 ``rows`` is a hard bound.
    """
    total = docs.count()
    own = docs.select(*(F.col(f"`{c}`") for c in columns))
    if total <= rows:
        return own
    keyed = own.select(F.xxhash64(*own.columns).alias("key"), F.struct(*own.columns).alias("row")).where(F.pmod("key", F.lit(total)) < rows)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = keyed.groupBy("key").agg(F.first("row").alias("row")).limit(2 * rows).repartition(min(tasks, 32))
    return once.select(*(F.col("row").getField(c).alias(c) for c in columns))


def drop(spark: SparkSession, path: str) -> None:
    """Delete a path made by ``new_path`` or ``written``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
