"""Queries by name, with their SQL for another engine where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import common_tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, using: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query. ``using``: relations that ``sql`` reads, put before it as common table expressions.

    ``sql`` may start with further expressions of its own, ``name as (...),``, marked by a leading ``with``.
    """

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            own = sql.strip()
            tables = common_tables(using)
            if own.lower().startswith("with recursive "):
                own = "with recursive " + ", ".join([*tables, own[15:].lstrip()])
            elif own.lower().startswith("with "):
                own = "with " + ", ".join([*tables, own[5:].lstrip()])
            elif tables:
                own = f"with {', '.join(tables)} {own}"
            ORACLES[function.__name__] = own
        return function

    return register


def doubles(df: DataFrame) -> DataFrame:
    """Decimals as doubles, as results are compared across engines that give sums different scales."""
    return df.select(*[df[c].cast("double").alias(c) if kind.startswith("decimal") else df[c] for c, kind in df.dtypes])
