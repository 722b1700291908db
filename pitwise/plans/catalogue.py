"""Registered queries of the library and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chain_queries, contract_queries, decision_queries, distribution_queries, feature_queries, league, metric_queries, model_queries, rolling_queries, table_queries
from .feature_queries import flagship

__all__ = ["flagship", "oracle_sql", "queries"]

#: name -> (query, SQL or None, double columns that are rounded on both sides)
_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None, list[str]]] = {}
for _module in (table_queries, feature_queries, metric_queries, model_queries, decision_queries, contract_queries, chain_queries, rolling_queries, distribution_queries):
    _ALL.update(_module.QUERIES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def rounding(query: Callable[[SparkSession, str], DataFrame], doubles: list[str]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: league.rounded(query(spark, sf_dir)) if doubles else query(spark, sf_dir)

    return {name: rounding(query, doubles) for name, (query, _, doubles) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (_, sql, doubles) in _ALL.items():
        if sql:
            swap = ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in doubles)
            out[name] = f"SELECT * REPLACE ({swap}) FROM ({sql}) AS q" if doubles else sql
    return out
