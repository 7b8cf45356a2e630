"""Registry of the engine's own queries over the driver tables, with their SQL counterparts."""

from __future__ import annotations

from laminar.ship import shipped

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = shipped(f)
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add
