"""The catalogue of the core's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.plans import answer_queries, pipeline_queries, reasoning_queries, table_queries

FLAGSHIP = "eval_report"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return pipeline_queries.queries() | table_queries.QUERIES | answer_queries.QUERIES | reasoning_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return table_queries.SQL | answer_queries.SQL | reasoning_queries.SQL
