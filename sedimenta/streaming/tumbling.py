"""Streams into the same layout, and tumbling buckets with a watermark.

An extension: the engine's tables grow by batches otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from sedimenta.functions.times import shard_name
from sedimenta.schema import SHARD


def tumbling(stream: DataFrame, time: str, width: str, aggregates: list[Column], keys: list[str] = (), late: str = "1 hour") -> DataFrame:
    """Aggregates by bucket of ``width`` and keys; rows later than ``late`` are dropped, and state with them."""
    at = F.col(time).cast("timestamp")
    return (
        stream.withColumn("__at", at)
        .withWatermark("__at", late)
        .groupBy(F.window("__at", width).alias("__w"), *keys)
        .agg(*aggregates)
        .select(F.col("__w.start").cast("timestamp_ntz").alias("bucket"), *keys, *(c for c in _names(stream, time, width, aggregates, keys)))
    )


def _names(stream: DataFrame, time: str, width: str, aggregates: list[Column], keys: list[str]) -> list[str]:
    flat = stream.sparkSession.createDataFrame([], stream.schema).groupBy(*keys).agg(*aggregates)
    return flat.columns[len(keys) :]


def into_shards(stream: DataFrame, time: str, root: str, checkpoint: str, shard_by: str = "daily") -> DataStreamWriter:
    """Append a stream's rows to the shards of a dataset directory, each batch once."""
    named = stream.withColumn(SHARD, shard_name(F.unix_seconds(F.col(time).cast("timestamp")), shard_by))
    return named.writeStream.format("parquet").partitionBy(SHARD).option("path", root).option("checkpointLocation", checkpoint).outputMode("append")
