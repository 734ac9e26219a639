"""Time columns: parsing, shard buckets, calendar buckets.  Everything is UTC."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.errors import EngineError

#: Accepted texts, in the order in which they are tried: epoch seconds, RFC 3339, date and time, date.
EPOCH = r"^[+-]?\d+$"
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
DATE_TIME = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"
DATE = r"^\d{4}-\d{2}-\d{2}$"

SHARDINGS = ("none", "hourly", "daily", "weekly", "monthly")
SECONDS = {"hourly": 3600, "daily": 86_400, "weekly": 604_800}
NAMES = {"hourly": "yyyy-MM-dd'T'HH", "daily": "yyyy-MM-dd", "weekly": "yyyy-MM-dd", "monthly": "yyyy-MM"}
UNITS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")


def seconds_of_text(c: Column) -> Column:
    """Epoch seconds of a text in one of the accepted forms, null if in none."""
    t = F.trim(c)
    zoned = F.regexp_replace(F.regexp_replace(F.upper(t), "Z$", "+00:00"), " ", "T")
    return (
        F.when(t.rlike(EPOCH), t.try_cast("bigint"))
        .when(t.rlike(RFC3339), _whole(F.try_to_timestamp(F.regexp_replace(zoned, r"\.\d+", ""), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))))
        .when(t.rlike(DATE_TIME), _whole(F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss"))))
        .when(t.rlike(DATE), _whole(F.try_to_timestamp(t, F.lit("yyyy-MM-dd"))))
    )


def _whole(ts: Column) -> Column:
    return F.unix_seconds(ts)


def seconds_of(c: Column, kind: T.DataType) -> Column:
    """Epoch seconds of a column of a time-like type; parts of a second are cut toward zero."""
    if isinstance(kind, T.StringType):
        return seconds_of_text(c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return _toward_zero(F.unix_micros(c.cast("timestamp")), 1_000_000)
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("bigint") * 86_400
    if isinstance(kind, T.IntegralType):
        return c.cast("bigint")
    raise EngineError(f"a time field cannot be of type {kind.simpleString()}")


def _toward_zero(c: Column, by: int) -> Column:
    """Integer division that cuts toward zero, as SQL's ``div`` does."""
    n = F.lit(by).cast("bigint")
    return ((c - c % n) / n).cast("bigint")


def parse_bound(text: str, end_of_day: bool = False) -> int:
    """Epoch seconds of a bound in one of the accepted forms; a bare date may stand for its last second."""
    import re

    text = text.strip()
    if re.match(EPOCH, text):
        return int(text)
    for pattern, form in ((DATE_TIME, "%Y-%m-%d %H:%M:%S"), (DATE, "%Y-%m-%d")):
        if re.match(pattern, text):
            try:
                at = int(datetime.strptime(text, form).replace(tzinfo=timezone.utc).timestamp())
            except ValueError:
                break
            return at + 86_399 if end_of_day and form == "%Y-%m-%d" else at
    if re.match(RFC3339, text):
        return int(datetime.fromisoformat(re.sub("[zZ]$", "+00:00", text)).timestamp() // 1)
    raise EngineError(f"not a time: {text!r}")


def bucket_start(seconds: Column, sharding: str) -> Column:
    """First second of the bucket that a time lies in; weeks are counted from the epoch and so begin on Thursdays."""
    if sharding in SECONDS:
        width = F.lit(SECONDS[sharding]).cast("bigint")
        return seconds - F.pmod(seconds, width)
    if sharding == "monthly":
        return F.unix_seconds(F.date_trunc("month", F.timestamp_seconds(seconds)))
    return F.lit(0).cast("bigint")


def shard_name(seconds: Column, sharding: str) -> Column:
    if sharding not in SHARDINGS:
        raise EngineError(f"sharding is one of {', '.join(SHARDINGS)}")
    if sharding == "none":
        return F.lit("all")
    return F.date_format(F.timestamp_seconds(bucket_start(seconds, sharding)), NAMES[sharding])


def shard_name_of(seconds: int, sharding: str) -> str:
    """The same for one number, without Spark."""
    if sharding == "none":
        return "all"
    if sharding in SECONDS:
        seconds -= seconds % SECONDS[sharding]
    form = {"hourly": "%Y-%m-%dT%H", "daily": "%Y-%m-%d", "weekly": "%Y-%m-%d", "monthly": "%Y-%m"}[sharding]
    return datetime.fromtimestamp(seconds, timezone.utc).strftime(form)


def bucket(unit: str, ts: Column) -> Column:
    """Calendar bucket of a timestamp, without a zone; weeks begin on Mondays."""
    if unit not in UNITS:
        raise EngineError(f"a unit is one of {', '.join(UNITS)}")
    return F.date_trunc(unit, ts).cast("timestamp_ntz")
