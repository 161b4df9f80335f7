"""All registered queries of the engine and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the DuckDB SQL of the same rows."""

    def put(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = (f, sql)
        return f

    return put


def load() -> None:
    """Import the modules whose queries register themselves."""
    from statuta.plans import corpus_queries, incremental_queries, lifecycle_queries, retrieval_queries, user_queries  # noqa: F401


def queries() -> dict[str, Query]:
    load()
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return {k: sql for k, (_, sql) in _QUERIES.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["z2_hybrid_retrieval"](spark, sf_dir)
