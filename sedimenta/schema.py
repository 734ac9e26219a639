"""Declared roles of a dataset's fields, kept beside its shards as JSON.

A field is the time field, a metric (aggregated), an int (filtered and
aggregated) or a string (filtered).  Metrics and ints are stored as 64-bit
integers; ``scale`` says by which power of ten a fraction was multiplied, and
is not applied again when reading.  The sidecar also says how the shards are cut.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import types as T

from sedimenta.errors import SchemaConflict

TIME, METRIC, INT, STRING = "time", "metric", "int", "string"
SIDECAR = "_schema.json"
SHARD = "_shard"


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    scale: int = 0
    nullable: bool = False

    def spark(self) -> T.StructField:
        kind = T.StringType() if self.kind == STRING else T.LongType()
        return T.StructField(self.name, kind, True, {"kind": self.kind, "scale": self.scale})


@dataclass(frozen=True)
class DatasetSchema:
    fields: tuple[Field, ...]
    sharding: str | None = None  # not known of datasets whose sidecar does not say

    @property
    def time(self) -> str | None:
        return next((f.name for f in self.fields if f.kind == TIME), None)

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(name)

    def spark(self) -> T.StructType:
        """Columns as they are stored; the time field holds epoch seconds."""
        return T.StructType([f.spark() for f in self.fields])

    def merged(self, other: DatasetSchema) -> DatasetSchema:
        """This schema with the other's observed nulls; the rest has to agree."""
        shape = lambda s: [(f.name, f.kind, f.scale) for f in s.fields]
        if shape(self) != shape(other):
            raise SchemaConflict(f"schema conflict: dataset has {shape(self)}, this run has {shape(other)}")
        if self.sharding and other.sharding and self.sharding != other.sharding:
            raise SchemaConflict(f"schema conflict: dataset is sharded {self.sharding}, this run {other.sharding}")
        return DatasetSchema(tuple(replace(a, nullable=a.nullable or b.nullable) for a, b in zip(self.fields, other.fields)), other.sharding or self.sharding)

    def to_json(self) -> str:
        return json.dumps({"fields": [vars(f) for f in self.fields], "sharding": self.sharding}, indent=1)

    @classmethod
    def from_json(cls, text: str) -> DatasetSchema:
        found = json.loads(text)
        return cls(tuple(Field(**f) for f in found["fields"]), found.get("sharding"))
