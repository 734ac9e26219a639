"""Settings from arguments, environment, a TOML file and defaults, in that order; sizes in bytes."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from sedimenta.errors import EngineError

_UNITS = {"": 1, "b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12, "kib": 2**10, "mib": 2**20, "gib": 2**30, "tib": 2**40, "k": 2**10, "m": 2**20, "g": 2**30, "t": 2**40}


def parse_size(text: str | int, whole: int | None = None) -> int:
    """Bytes of a size such as ``10GB``, ``512MiB`` or, of ``whole``, ``50%``."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*|%)\s*", str(text))
    if not m:
        raise EngineError(f"not a size: {text!r}")
    number, unit = float(m[1]), m[2].lower()
    if unit == "%":
        if whole is None or number > 100:
            raise EngineError(f"a share is of something, and 100% at most: {text!r}")
        return int(whole * number / 100)
    if unit not in _UNITS:
        raise EngineError(f"unknown unit: {text!r}")
    return int(number * _UNITS[unit])


@dataclass(frozen=True)
class Settings:
    storage: str = "."
    memory: int = 4 * 10**9
    session_share: int = 20
    idle_seconds: int = 1800
    age_seconds: int = 4 * 3600
    ticket_seconds: int = 300
    sweep_seconds: int = 60
    cache_share: int = 20  # per cent of memory
    shuffle_partitions: int = 0  # 0: Spark's own

    @classmethod
    def load(cls, given: dict | None = None, file: str | None = None, environ: dict | None = None) -> Settings:
        environ = os.environ if environ is None else environ
        from_file = {}
        if file:
            with open(file, "rb") as f:
                from_file = tomllib.load(f)
        out = {}
        for f in fields(cls):
            for source, key in (((given or {}), f.name), (environ, f"SEDIMENTA_{f.name.upper()}"), (from_file, f.name)):
                if source.get(key) is not None:
                    v = source[key]
                    out[f.name] = v if f.type == "str" else parse_size(v)
                    break
        return cls(**out)


def session(settings: Settings | None = None, master: str | None = None) -> SparkSession:
    """A Spark session with what the engine relies on: UTC, ANSI names, adaptive plans, dynamic overwrite."""
    s = settings or Settings()
    b = SparkSession.builder.appName("sedimenta")
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.ansi.doubleQuotedIdentifiers": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if s.shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(s.shuffle_partitions)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
