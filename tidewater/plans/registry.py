"""Where plans register their queries, each with the SQL that an oracle runs for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources.derived import Tables, ctes

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of Tables; sql is the oracle's final SELECT, before which the derived tables it names are put."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = ctes(sql)
        return f

    return register
