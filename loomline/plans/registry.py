"""Named queries with their SQL twins (DuckDB dialect)."""

from __future__ import annotations

from loomline.cluster import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register f(t) -> DataFrame under a name, where t(table name) reads a table."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda n: table(spark, sf_dir, n))
        if sql:
            ORACLES[name] = sql
        return f

    return add
