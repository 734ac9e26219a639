"""The small filter language of the native query: ``f=v``, ``f=lo..hi``, ``f=lo..``, ``f=..hi``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedimenta.errors import QueryError
from sedimenta.schema import STRING, TIME, DatasetSchema
from sedimenta.schema import INT as INT_KIND


@dataclass(frozen=True)
class Clause:
    """Equality with ``value``, or an inclusive range from ``lo`` to ``hi`` (either may be open)."""

    name: str
    value: str | None = None
    lo: str | None = None
    hi: str | None = None

    def __str__(self) -> str:
        return f"{self.name}={self.value}" if self.value is not None else f"{self.name}={self.lo or ''}..{self.hi or ''}"


def parse(text: str) -> Clause:
    """A clause from its text; the first ``=`` ends the name, the first ``..`` parts a range."""
    name, eq, rest = text.partition("=")
    if not eq or not name or not rest:
        raise QueryError(f"a filter is name=value or name=from..to: {text!r}")
    lo, dots, hi = rest.partition("..")
    if not dots:
        return Clause(name, value=rest)
    if not lo and not hi:
        raise QueryError(f"a range has one bound at least: {text!r}")
    return Clause(name, lo=lo or None, hi=hi or None)


def _bound(clause: Clause, text: str) -> int:
    try:
        return int(text)
    except ValueError:
        raise QueryError(f"{clause.name} is a number; {text!r} is none") from None


def condition(clause: Clause, schema: DatasetSchema) -> Column:
    """The clause over stored columns; metrics cannot be filtered here."""
    try:
        kind = schema.field(clause.name).kind
    except KeyError:
        raise QueryError(f"unknown field: {clause.name}") from None
    if kind not in (INT_KIND, STRING, TIME):
        raise QueryError(f"{clause.name} is a metric and cannot be filtered")
    as_value = (lambda x: x) if kind == STRING else (lambda x: _bound(clause, x))
    c = F.col(f"`{clause.name}`")
    if clause.value is not None:
        return c == as_value(clause.value)
    lo, hi = (None if x is None else as_value(x) for x in (clause.lo, clause.hi))
    if lo is not None and hi is not None and lo > hi:
        raise QueryError(f"the bounds of {clause.name} are the wrong way round")
    out = F.lit(True)
    if lo is not None:
        out = out & (c >= lo)
    if hi is not None:
        out = out & (c <= hi)
    return out
