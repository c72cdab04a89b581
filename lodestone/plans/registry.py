"""Every registered query of the library's own operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import check_queries, text_queries, vector_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**text_queries.QUERIES, **vector_queries.QUERIES, **check_queries.QUERIES}
SQL: dict[str, str] = {**text_queries.SQL, **vector_queries.SQL, **check_queries.SQL}
