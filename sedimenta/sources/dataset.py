"""Datasets: opening, shards, pruning by time, and registration as views."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta import storage
from sedimenta.errors import QueryError
from sedimenta.functions import times
from sedimenta.schema import INT, SHARD, SIDECAR, STRING, DatasetSchema


@dataclass(frozen=True)
class Dataset:
    """A directory of shards that share a schema."""

    spark: SparkSession
    root: str
    schema: DatasetSchema

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Dataset:
        text = storage.read_text(spark, f"{root}/{SIDECAR}")
        if text is None:
            raise QueryError(f"not a dataset: {root}")
        return cls(spark, root, DatasetSchema.from_json(text))

    def stored(self) -> DataFrame:
        """The shards as stored: 64-bit integers, strings, and the shard's name."""
        shape = self.schema.spark().add(SHARD, "string")
        return self.spark.read.schema(shape).option("basePath", self.root).parquet(self.root)

    def frame(self, keep_shard: bool = False) -> DataFrame:
        """The table that queries see: the time field is a timestamp without a zone, in UTC."""
        df = self.stored()
        time = self.schema.time
        out = [
            (F.timestamp_seconds(F.col(f"`{f.name}`")).cast("timestamp_ntz") if f.name == time else F.col(f"`{f.name}`")).alias(f.name)
            for f in self.schema.fields
        ]
        return df.select(*out, *([SHARD] if keep_shard else []))

    def shards(self) -> DataFrame:
        """(shard, docs, min_time, max_time) of every shard."""
        time = F.col(f"`{self.schema.time}`")
        return self.stored().groupBy(F.col(SHARD).alias("shard")).agg(F.count("*").alias("docs"), F.min(time).alias("min_time"), F.max(time).alias("max_time"))

    def inspect(self, shard: str) -> DataFrame:
        """(field, kind, scale, terms): fields of a shard and how many distinct values indexed ones have."""
        df = self.stored().where(F.col(SHARD) == shard)
        indexed = [f for f in self.schema.fields if f.kind in (INT, STRING)]
        counts = [F.struct(F.lit(f.name).alias("field"), F.count_distinct(F.col(f"`{f.name}`")).alias("terms")) for f in indexed]
        kinds = self.spark.createDataFrame([(f.name, f.kind, f.scale) for f in self.schema.fields], "field string, kind string, scale int")
        if not counts:
            return kinds.withColumn("terms", F.lit(None).cast("bigint"))
        terms = df.agg(F.array(*counts).alias("t")).select(F.explode("t").alias("t")).select("t.*")
        return kinds.join(F.broadcast(terms), "field", "left")  # one row a field

    def sharding(self) -> str:
        """How the shards are cut: what the sidecar says, else what all names agree on; ``none`` if they do not."""
        if self.schema.sharding:
            return self.schema.sharding
        names = storage.children(self.spark, self.root)
        lengths = {len(n.split("=", 1)[1].replace("%3A", ":")) for n in names if n.startswith(f"{SHARD}=")}
        if len(lengths) != 1:
            return "none"
        # a daily name may be that of a week, whose bucket begins up to six days before
        return {3: "none", 7: "monthly", 10: "weekly", 13: "hourly"}.get(lengths.pop(), "none")

    def where_time(self, lo: int | None = None, hi: int | None = None) -> DataFrame:
        """Rows of a closed range of epoch seconds; shards outside it are not listed for reading.

        Bounds on the shard's name follow from those on the time, since names
        sort as their buckets do; without them only row groups would be skipped.
        """
        by = self.sharding()
        df, time = self.frame(keep_shard=True), F.col(f"`{self.schema.time}`")
        stamp = lambda s: F.timestamp_seconds(F.lit(s)).cast("timestamp_ntz")
        if lo is not None:
            df = df.where(time >= stamp(lo))
            if by != "none":
                df = df.where(F.col(SHARD) >= times.shard_name_of(lo, by))
        if hi is not None:
            df = df.where(time <= stamp(hi))
            if by != "none":  # a day's name is not after that of the week or day which holds it
                df = df.where(F.col(SHARD) <= times.shard_name_of(hi, "daily" if by == "weekly" else by))
        return df.drop(SHARD)

    def whole_shards(self, lo: int, hi: int) -> DataFrame:
        """Stored rows of every shard whose range of times meets the window; rows in it are not filtered."""
        kept = self.shards().where((F.col("min_time") <= hi) & (F.col("max_time") >= lo)).select(F.col("shard").alias(SHARD))
        return self.stored().join(kept, SHARD, "left_semi")

    def register(self, name: str) -> None:
        self.frame().createOrReplaceTempView(name)


def datasets(spark: SparkSession, root: str) -> list[str]:
    """Names of the datasets next to the root."""
    return [n for n in storage.children(spark, root) if storage.exists(spark, f"{root}/{n}/{SIDECAR}")]
