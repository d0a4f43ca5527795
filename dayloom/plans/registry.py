"""Every query of the library by name, with its SQL counterpart."""

from __future__ import annotations

from . import core, feeds
from .chain import Chain

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, build, sql: str | None = None) -> None:
    """Register build(Chain) under name; sql gives the same rows in DuckDB."""
    QUERIES[name] = lambda spark, sf_dir: build(Chain(spark, sf_dir))
    if sql:
        ORACLE_SQL[name] = sql


core.register(query)
feeds.register(query)
