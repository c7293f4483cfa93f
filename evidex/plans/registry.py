"""Where queries register: a name, a function of (spark, sf_dir), and DuckDB SQL for the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its own name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def standard(name: str, text: str, *tables: str) -> None:
    """Registers a query in SQL that Spark and DuckDB read alike; `{orders}` stands for a table."""
    from ..session import sql

    QUERIES[name] = lambda spark, sf: sql(spark, sf, text, *tables)
    ORACLES[name] = text.format(**{t: t for t in tables})
