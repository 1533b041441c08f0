"""The registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mediafold.plans import case_queries, file_queries, large_queries, store_queries, tag_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {**tag_queries.QUERIES, **text_queries.QUERIES, **file_queries.QUERIES, **large_queries.QUERIES, **case_queries.QUERIES, **store_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**tag_queries.SQL, **text_queries.SQL, **file_queries.SQL, **large_queries.SQL, **case_queries.SQL, **store_queries.SQL}
