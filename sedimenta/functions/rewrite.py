"""Names that queries use and Spark has otherwise.

``prepare`` gives a session the SQL function ``theta_intersect``; ``rewrite``
turns calls of ``approx_distinct``, ``approx_percentile_cont``, ``approx_top_k``,
``theta`` and ``date_bin`` in a statement into Spark's, with the arguments that they imply,
and ``CREATE VIEW`` into a view of the session.  Strings, quoted names and
comments are left alone.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from sedimenta.errors import QueryError
from sedimenta.functions.sketches import DISTINCT_LG, THETA_ENTRIES, lg_entries

_TOKEN = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|--[^\n]*|/\*.*?\*/|[A-Za-z_][A-Za-z_0-9]*|\s+|.""", re.S)


def prepare(spark: SparkSession) -> SparkSession:
    """Functions and settings that every session needs, since new sessions begin without."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    spark.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION theta_intersect(a BINARY, b BINARY) RETURNS BIGINT "
        "RETURN theta_sketch_estimate(theta_intersection(a, b))"
    )
    return spark


def _arguments(tokens: list[str], at: int) -> tuple[list[str], int]:
    """Texts of the arguments of a call whose bracket opens at ``at``, and the place after its end."""
    depth, args, now = 0, [], []
    for i in range(at, len(tokens)):
        t = tokens[i]
        if t in "([":
            depth += 1
            if depth == 1:
                continue
        elif t in ")]":
            depth -= 1
            if not depth:
                last = "".join(now).strip()
                return args + ([last] if last or args else []), i + 1
        elif t == "," and depth == 1:
            args.append("".join(now).strip())
            now = []
            continue
        now.append(t)
    raise QueryError("a bracket is not closed")


def _call(name: str, args: list[str]) -> str:
    args = [rewrite(a) for a in args]
    if name == "approx_distinct" and len(args) == 1:
        return f"theta_sketch_estimate(theta_sketch_agg({args[0]}, {DISTINCT_LG}))"
    if name == "approx_percentile_cont" and len(args) in (2, 3):
        centroids = int(args[2]) if len(args) == 3 else 100
        return f"CAST(percentile_approx({args[0]}, {args[1]}, {max(100, centroids) * 100}) AS BIGINT)"
    if name == "approx_top_k" and len(args) in (2, 3):
        return _top(args[0], int(args[1]), int(args[2]) if len(args) == 3 else 0)
    if name == "theta" and len(args) in (1, 2):
        return f"theta_sketch_agg({args[0]}, {lg_entries(int(args[1]) if len(args) == 2 else THETA_ENTRIES)})"
    if name == "date_bin" and len(args) == 2:
        return f"window({args[1]}, {_duration(args[0])}).start"
    raise QueryError(f"{name} takes other arguments than ({', '.join(args)})")


#: Values that an ``approx_top_k`` keeps count of, and gives out to be ordered; exact for fewer different ones.
TRACKED, LISTED = 100_000, 10_000


def _top(value: str, k: int, capacity: int) -> str:
    """The k most frequent values as an array of (value, count): count descending, value ascending; nulls do not count."""
    if not 1 <= k <= LISTED:
        raise QueryError(f"k is from 1 to {LISTED}")
    found = f"approx_top_k({value}, {LISTED}, {max(TRACKED, capacity)}) FILTER (WHERE ({value}) IS NOT NULL)"
    order = "(a, b) -> CASE WHEN a.count > b.count THEN -1 WHEN a.count < b.count THEN 1 WHEN a.item < b.item THEN -1 WHEN a.item > b.item THEN 1 ELSE 0 END"
    return f"transform(slice(array_sort({found}, {order}), 1, {k}), t -> named_struct('value', t.item, 'count', t.count))"


def _duration(arg: str) -> str:
    """An interval literal as the duration text that windows take."""
    return re.sub(r"(?i)^\s*interval\s+", "", arg)


NAMES = ("approx_distinct", "approx_percentile_cont", "approx_top_k", "theta", "date_bin")


def rewrite(sql: str) -> str:
    """The statement with the engine's names replaced."""
    tokens, out, i = _TOKEN.findall(sql), [], 0
    words = [(k, t.lower()) for k, t in enumerate(tokens) if not t.isspace() and not t.startswith(("--", "/*"))]
    if [w for _, w in words[:2]] == ["create", "view"]:
        tokens[words[0][0]] += " TEMPORARY"
    elif [w for _, w in words[:4]] == ["create", "or", "replace", "view"]:
        tokens[words[2][0]] += " TEMPORARY"
    while i < len(tokens):
        j = i + 1
        while j < len(tokens) and tokens[j].isspace():
            j += 1
        if tokens[i].lower() in NAMES and j < len(tokens) and tokens[j] == "(":
            args, i = _arguments(tokens, j)
            out.append(_call(_name_before(tokens, j), args))
            continue
        out.append(tokens[i])
        i += 1
    return "".join(out)


def _name_before(tokens: list[str], bracket: int) -> str:
    k = bracket - 1
    while tokens[k].isspace():
        k -= 1
    return tokens[k].lower()
