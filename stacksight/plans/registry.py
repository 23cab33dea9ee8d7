"""The registered catalog queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stacksight.sources.library import Library, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(key: str, build: Callable[[Library], DataFrame], sql: str | None = None) -> None:
    """A query over the library views under the inventory's key; sql is its twin over the same views, for DuckDB."""
    QUERIES[key] = lambda spark, sf_dir: build(Library(spark, sf_dir))
    if sql:
        SQL[key] = with_views(sql.strip())


def _load() -> None:
    from stacksight.plans import catalog_queries, discovery_queries, entity_queries, function_queries, list_queries, provider_queries  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
