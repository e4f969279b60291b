"""Query registry: a Spark callable and, where SQL can say it, its DuckDB twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.catalog.tables import CTES, Tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the shared CTEs it names, directly or through other CTEs."""
    known = {**CTES, **(extra or {})}
    order: list[str] = []
    open_names: list[str] = []

    def walk(text: str) -> None:
        for word in re.findall(r"[a-z_0-9]+", text):
            if word in known and word not in order and word not in open_names:
                open_names.append(word)
                walk(known[word])
                open_names.pop()
                order.append(word)

    walk(body)
    if not order:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({known[n]})" for n in order) + "\n" + body


def query(name: str, sql: str | None = None, ctes: dict[str, str] | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = with_ctes(sql.strip(), ctes)
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column so that summation order cannot show."""
    return df.select(
        *[
            F.round(F.col(f"`{n}`"), digits).alias(n) if t in ("double", "float") else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    return dict(_SQL)
