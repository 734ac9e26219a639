"""Every query of the engine itself, with its SQL where SQL can express it."""

from __future__ import annotations

from sedimenta.plans import engine_queries, relational_queries


def queries() -> dict:
    return {**engine_queries.queries(), **relational_queries.queries()}


def oracle_sql() -> dict:
    return {**engine_queries.oracle_sql(), **relational_queries.oracle_sql()}
