"""Ingest: delimited text or Parquet into a dataset of time-partitioned shards.

Rows keep the declared fields only.  Checks (unknown and duplicate columns,
values that do not fit, no rows, schema conflicts) come before anything is
published; publishing replaces just the shards that the run has rows for.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta import storage
from sedimenta.errors import IngestError
from sedimenta.functions import times
from sedimenta.schema import INT, METRIC, SHARD, SIDECAR, STRING, TIME, DatasetSchema, Field

DEFAULT_FLOAT_SCALE = 3
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


@dataclass(frozen=True)
class Roles:
    """What a run declares: the time field, metrics, ints, strings, scales of fractions, and how to shard."""

    time: str
    metrics: tuple[str, ...] = ()
    ints: tuple[str, ...] = ()
    strings: tuple[str, ...] = ()
    scales: dict[str, int] = field(default_factory=dict)
    shard_by: str = "daily"

    def __post_init__(self):
        names = [self.time, *self.metrics, *self.ints, *self.strings]
        twice = sorted({n for n in names if names.count(n) > 1})
        if twice:
            raise IngestError(f"declared twice: {', '.join(twice)}")
        if self.shard_by not in times.SHARDINGS:
            raise IngestError(f"sharding is one of {', '.join(times.SHARDINGS)}")
        strange = sorted(set(self.scales) - {*self.metrics, *self.ints})
        if strange:
            raise IngestError(f"a scale is for a metric or int: {', '.join(strange)}")


def scale_fraction(c: Column, scale: int) -> Column:
    """round(v * 10**scale), half away from zero, held within 64 bits; NaN is 0."""
    v = F.round(c.cast("double") * F.lit(10.0**scale))
    v = F.when(F.isnan(v), 0.0).otherwise(v)
    return F.when(v >= float(LONG_MAX), F.lit(LONG_MAX)).when(v <= float(LONG_MIN), F.lit(LONG_MIN)).otherwise(v.try_cast("bigint"))


def scale_decimal(c: Column, kind: T.DecimalType) -> Column:
    """The decimal's mantissa; null if it has more than 64 bits."""
    return F.try_multiply(c.cast(T.DecimalType(38, kind.scale)), F.lit(10**kind.scale).cast("decimal(38,0)")).try_cast("bigint")


def numeric(c: Column, kind: T.DataType, name: str, scales: dict[str, int]) -> tuple[Column, int]:
    """A numeric column as 64-bit integers, and its scale."""
    if isinstance(kind, T.DecimalType):
        if name in scales:
            raise IngestError(f"{name}: a decimal has its own scale")
        return scale_decimal(c, kind), kind.scale
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        scale = scales.get(name, DEFAULT_FLOAT_SCALE)
        return scale_fraction(c, scale), scale
    if isinstance(kind, T.IntegralType):
        if name in scales:
            raise IngestError(f"{name}: an integer has no scale")
        return c.cast("bigint"), 0
    raise IngestError(f"{name}: a numeric field cannot be of type {kind.simpleString()}")


def whole_number(c: Column) -> Column:
    """A text of digits as a 64-bit integer, null if it is none."""
    return F.when(F.trim(c).rlike(times.EPOCH), F.trim(c).try_cast("bigint"))


def _take(df: DataFrame, roles: Roles, text_numbers: bool = False) -> tuple[DataFrame, list[Field]]:
    """The declared fields as they are stored, with ``__bad`` set where a value does not fit."""
    missing = [n for n in (roles.time, *roles.metrics, *roles.ints, *roles.strings) if n not in df.columns]
    if missing:
        raise IngestError(f"unknown column: {', '.join(missing)}")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    col = lambda n: F.col(f"`{n}`")
    at = times.seconds_of(col(roles.time), kinds[roles.time])
    out, bad, fields = [at.alias(roles.time)], at.isNull(), [Field(roles.time, TIME)]
    for kind, names in ((METRIC, roles.metrics), (INT, roles.ints)):
        for n in names:
            value, scale = (whole_number(col(n)), 0) if text_numbers else numeric(col(n), kinds[n], n, roles.scales)
            out.append(value.alias(n))
            bad = bad | (value.isNull() & col(n).isNotNull())
            fields.append(Field(n, kind, scale))
    for n in roles.strings:
        if not isinstance(kinds[n], T.StringType):
            raise IngestError(f"{n}: a string field cannot be of type {kinds[n].simpleString()}")
        out.append(col(n).alias(n))
        fields.append(Field(n, STRING))
    return df.select(*out, bad.alias("__bad")), fields


def read_delimited(spark: SparkSession, path: str, roles: Roles, delimiter: str = ",") -> tuple[DataFrame, list[Field]]:
    """Text with a header row; empty fields are null and numbers are whole."""
    if len(delimiter) != 1 or not delimiter.isascii():
        raise IngestError("a delimiter is one ASCII character")
    if roles.scales:
        raise IngestError("delimited text takes no scales")
    raw = spark.read.option("header", True).option("sep", delimiter).option("mode", "FAILFAST").option("inferSchema", False).csv(path)
    return _take(raw.select(*(F.nullif(F.col(f"`{n}`"), F.lit("")).alias(n) for n in raw.columns)), roles, True)


def read_parquet(spark: SparkSession, path: str, roles: Roles) -> tuple[DataFrame, list[Field]]:
    """Typed columns: integers as they are, decimals by their mantissa, fractions by their scale."""
    return _take(spark.read.parquet(path), roles)


def format_of(path: str, given: str | None = None) -> str:
    if given:
        if given not in ("csv", "tsv", "parquet"):
            raise IngestError(f"unknown format: {given}")
        return given
    name = path.rstrip("/").lower()
    return "parquet" if name.endswith((".parquet", ".pq")) else "tsv" if name.endswith((".tsv", ".tab")) else "csv"


def ingest(spark: SparkSession, source: str, root: str, roles: Roles, kind: str | None = None, delimiter: str | None = None) -> DatasetSchema:
    """Read ``source`` and publish it as shards of the dataset at ``root``; returns the dataset's schema."""
    kind = format_of(source, kind)
    if kind == "parquet":
        rows, fields = read_parquet(spark, source, roles)
    else:
        rows, fields = read_delimited(spark, source, roles, delimiter or ("\t" if kind == "tsv" else ","))
    return publish(rows, fields, root, roles)


def publish(rows: DataFrame, fields: list[Field], root: str, roles: Roles) -> DatasetSchema:
    """Check, reconcile the schema, then replace the shards that ``rows`` has rows for."""
    spark = rows.sparkSession
    seen = rows.agg(F.count("*").alias("n"), F.count_if("__bad").alias("bad"), *(F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"null_{i}") for i, f in enumerate(fields))).first()
    if not seen["n"]:
        raise IngestError("no rows")
    if seen["bad"]:
        raise IngestError(f"{seen['bad']} rows have a time or number that does not fit")
    now = DatasetSchema(tuple(Field(f.name, f.kind, f.scale, bool(seen[f"null_{i}"])) for i, f in enumerate(fields)), roles.shard_by)
    before = storage.read_text(spark, f"{root}/{SIDECAR}")
    schema = DatasetSchema.from_json(before).merged(now) if before else now
    time = F.col(f"`{roles.time}`")
    (
        rows.drop("__bad")
        .withColumn(SHARD, times.shard_name(time, roles.shard_by))
        .hint("rebalance", SHARD)  # one task a shard, more where a shard is large
        .sortWithinPartitions(SHARD, roles.time)
        .write.partitionBy(SHARD)
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(root)
    )
    storage.write_text(spark, f"{root}/{SIDECAR}", schema.to_json())
    return schema
